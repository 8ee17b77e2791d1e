"""Text analysis: tokens, stems, links, rule-based facts, query intent."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The analyzer's stop words.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "shall",
    "should", "may", "might", "must", "can", "could",
    "of", "in", "to", "for", "with", "on", "at", "by", "from", "as",
    "into", "through", "during", "before", "after", "above", "below",
    "between", "out", "off", "over", "under", "again", "further", "then",
    "once",
    "and", "but", "or", "nor", "not", "so", "yet",
    "both", "either", "neither", "each", "every", "all", "any", "few",
    "more", "most", "other", "some", "such", "no", "only", "own", "same",
    "than", "too", "very", "just", "because",
    "it", "its", "this", "that", "these", "those",
    "i", "you", "he", "she", "we", "they",
    "what", "which", "who", "whom", "how", "where", "when", "why",
    "am", "if", "about", "up", "down", "here", "there",
)

# Phrases that tell a query's intent, tried in this order.
STRONG_TEMPORAL = (
    "when ", "when's", "how long", "how often", "for how many days", "for how many weeks", "for how many months",
    "for how many years", "for how many hours", "for how many minutes", "duration",
)
NUMERIC = (
    "how many", "how much", "total", "sum", "count", "average", "median", "minimum", "maximum", "number of", "spend",
    "cost", "price", "budget", "amount", "$",
)
WEAK_TEMPORAL = (
    " days", " weeks", " months", " years", " hours", " minutes", "before ", "after ", "since ", "until ", "earliest",
    "latest", "first time", "last time",
)
# Words that tell that a fact is about a date.
DATE_HINTS = (
    " day", " week", " month", " year", " hour",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "yesterday", "today", "tomorrow",
)

# Patterns of the rule extractor.
RULES = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?:^|\s|\()(\+?\d{1,3}[\s\-]?)?\(?\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}\b",
    "url": r"https?://[^\s<>'\"]+",
    "date": r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\b",
}


def raw_tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def tokens(text: Column, *, stem_words: bool = True) -> Column:
    """Analysed tokens: without stop words, stemmed."""
    kept = F.filter(raw_tokens(text), lambda t: ~t.isin(*STOP_WORDS))
    return F.transform(kept, stem) if stem_words else kept


def has_tokens(text: Column) -> Column:
    return F.size(tokens(text, stem_words=False)) > 0


# The public "Porter2" stemmer for English: suffixes with what replaces them, longest first, and exceptions.
STEM_2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"),
    ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"),
    ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"),
)
STEM_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEM_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
STEM_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STEM_KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEM_REGION = "^(?:gener|commun|arsen|.*?[aeiouy][^aeiouy])"
STEM_SHORT = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
STEM_DOUBLE = "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"


def _once(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def stem(word: Column) -> Column:
    """The stem of an English word in lower case by the Porter2 algorithm, as an expression."""
    less = lambda w, n: w.substr(F.lit(1), F.length(w) - n)

    def marked(word: Column) -> Column:
        """y that is a consonant as Y."""
        return F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")

    def stems(m: Column) -> Column:
        first = F.length(F.regexp_extract(m, STEM_REGION, 0))
        r1 = F.when(first > 0, first).otherwise(F.length(m))
        return _once(r1, lambda a: _once(after(m, a), lambda b: steps(m, a, b)))

    def after(m: Column, a: Column) -> Column:
        n = F.length(F.regexp_extract(m.substr(a + 1, F.length(m)), "^.*?[aeiouy][^aeiouy]", 0))
        return F.when(n > 0, a + n).otherwise(F.length(m))

    def steps(m: Column, r1: Column, r2: Column) -> Column:
        within = lambda w, n, r: F.length(w) - n >= r

        def one_a(w: Column) -> Column:
            return F.when(w.endswith("sses"), less(w, 2)).when(w.rlike("(?:ied|ies)$"), F.when(F.length(w) > 4, less(w, 2)).otherwise(less(w, 1))).when(w.rlike("(?:us|ss)$"), w).when(w.rlike("[aeiouy].+s$"), less(w, 1)).otherwise(w)

        def mended(w: Column) -> Column:
            return F.when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(STEM_DOUBLE), less(w, 1)).when((F.length(w) <= r1) & w.rlike(STEM_SHORT), F.concat(w, F.lit("e"))).otherwise(w)

        def one_b(w: Column) -> Column:
            past = F.when(w.rlike("[aeiouy].*(?:ingly|edly|ing|ed)$"), _once(F.regexp_replace(w, "(?:ingly|edly|ing|ed)$", ""), mended)).otherwise(w)
            return F.when(w.endswith("eedly"), F.when(within(w, 5, r1), less(w, 3)).otherwise(w)).when(w.endswith("eed"), F.when(within(w, 3, r1), less(w, 1)).otherwise(w)).otherwise(past)

        def one_c(w: Column) -> Column:
            return F.when(w.rlike("^.+[^aeiouy][yY]$"), F.concat(less(w, 1), F.lit("i"))).otherwise(w)

        def chain(w: Column, rules, region: Column, start: Column | None = None) -> Column:
            out = start
            for suffix, new in rules:
                made = F.when(within(w, len(suffix), region), F.concat(less(w, len(suffix)), F.lit(new))).otherwise(w)
                out = F.when(w.endswith(suffix), made) if out is None else out.when(w.endswith(suffix), made)
            return out

        def two(w: Column) -> Column:
            return chain(w, STEM_2, r1).when(w.endswith("ogi"), F.when(within(w, 3, r1) & w.endswith("logi"), less(w, 1)).otherwise(w)).when(w.endswith("li"), F.when(within(w, 2, r1) & w.rlike("[cdeghkmnrt]li$"), less(w, 2)).otherwise(w)).otherwise(w)

        def three(w: Column) -> Column:
            return chain(w, STEM_3, r1, F.when(w.endswith("ative"), F.when(within(w, 5, r2), less(w, 5)).otherwise(w))).otherwise(w)

        def four(w: Column) -> Column:
            return chain(w, [(x, "") for x in STEM_4], r2, F.when(w.rlike("[st]ion$"), F.when(within(w, 3, r2), less(w, 3)).otherwise(w))).otherwise(w)

        def five(w: Column) -> Column:
            e = within(w, 1, r2) | (within(w, 1, r1) & ~less(w, 1).rlike(STEM_SHORT))
            return F.when(w.endswith("e"), F.when(e, less(w, 1)).otherwise(w)).when(w.endswith("ll") & within(w, 1, r2), less(w, 1)).otherwise(w)

        def rest(w: Column) -> Column:
            out = w
            for step in (one_b, one_c, two, three, four, five):
                out = _once(out, step)
            return F.when(w.isin(*STEM_KEPT), w).otherwise(out)

        return F.lower(_once(one_a(m), rest))

    whole = F.when(F.length(word) <= 2, word)
    for w, out in STEM_WHOLE.items():
        whole = whole.when(word == w, F.lit(out))
    return whole.otherwise(_once(marked(word), stems))


def stem_word(word: str) -> str:
    """The same on the driver, for the words of a query."""
    if len(word) <= 2 or word in STEM_WHOLE:
        return STEM_WHOLE.get(word, word)
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    first = re.match(STEM_REGION, w)
    r1 = first.end() if first else len(w)
    second = re.match("^.*?[aeiouy][^aeiouy]", w[r1:])
    r2 = r1 + second.end() if second else len(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search("(?:ied|ies)$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif not re.search("(?:us|ss)$", w) and re.search("[aeiouy].+s$", w):
        w = w[:-1]
    if w in STEM_KEPT:
        return w
    if w.endswith("eedly"):
        w = w[:-3] if len(w) - 5 >= r1 else w
    elif w.endswith("eed"):
        w = w[:-1] if len(w) - 3 >= r1 else w
    elif re.search("[aeiouy].*(?:ingly|edly|ing|ed)$", w):
        w = re.sub("(?:ingly|edly|ing|ed)$", "", w)
        if re.search("(?:at|bl|iz)$", w) or not re.search(STEM_DOUBLE, w) and len(w) <= r1 and re.search(STEM_SHORT, w):
            w += "e"
        elif re.search(STEM_DOUBLE, w):
            w = w[:-1]
    if re.search("^.+[^aeiouy][yY]$", w):
        w = w[:-1] + "i"

    def replaced(w: str, rules, region: int) -> str:
        for suffix, new, ok in rules:
            if w.endswith(suffix):
                return w[: len(w) - len(suffix)] + new if ok(w) and len(w) - len(suffix) >= region else w
        return w

    always = lambda w: True
    w = replaced(w, [(a, b, always) for a, b in STEM_2] + [("ogi", "og", lambda w: w.endswith("logi")), ("li", "", lambda w: bool(re.search("[cdeghkmnrt]li$", w)))], r1)
    w = (w[:-5] if len(w) - 5 >= r2 else w) if w.endswith("ative") else replaced(w, [(a, b, always) for a, b in STEM_3], r1)
    w = (w[:-3] if len(w) - 3 >= r2 else w) if re.search("[st]ion$", w) else replaced(w, [(a, "", always) for a in STEM_4], r2)
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not re.search(STEM_SHORT, w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def has_stem(words: Column, wanted: str) -> Column:
    """Whether a word of an array has that stem. Stems keep a word's beginning, so few words are stemmed."""
    start = wanted[: max(1, len(wanted) - 2)]
    return F.exists(words, lambda t: t.startswith(start) & ~t.isin(*STOP_WORDS) & (stem(t) == wanted))


def intent(query: Column) -> Column:
    """temporal, numeric or identity."""
    q = F.lower(query)
    some = lambda ps: F.greatest(*[q.contains(p) for p in ps])
    return F.when(some(STRONG_TEMPORAL), "temporal").when(some(NUMERIC), "numeric").when(some(WEAK_TEMPORAL), "temporal").otherwise("identity")


def intent_boost(intent_: Column, kind: Column, text: Column, *, object_is_number: Column | None = None, due_at: Column | None = None) -> Column:
    """Multiplier of a memory of a kind for a query's intent."""
    number = F.lit(False) if object_is_number is None else object_is_number
    due = F.lit(False) if due_at is None else due_at.isNotNull()
    low = F.lower(F.coalesce(text, F.lit("")))
    numeric = F.when((kind == "fact") & number, 1.8).when((kind == "fact") & low.rlike(r"[0-9$€]"), 1.3).when(kind == "event", 1.1).otherwise(1.0)
    dated = F.greatest(*[low.contains(h) for h in DATE_HINTS])
    temporal = F.when(kind == "event", 1.6).when((kind == "task") & due, 1.4).when((kind == "fact") & dated, 1.3).otherwise(1.0)
    return F.when(intent_ == "numeric", numeric).when(intent_ == "temporal", temporal).otherwise(F.lit(1.0))


def wikilinks(markdown: Column) -> Column:
    """Ids of [[id]] and [[id|alias]] outside code, in order of first occurrence; ids are of a-z, 0-9, colon, _ and -."""
    bare = F.regexp_replace(F.regexp_replace(markdown, "(?s)```.*?(```|$)", " "), "`[^`]*`", " ")
    inner = F.regexp_extract_all(bare, F.lit(r"\[\[((?:(?!\[\[|\]\]).){1,256}?)\]\]"), 1)
    ids = F.transform(inner, lambda x: F.btrim(F.substring_index(x, "|", 1)))
    return F.array_distinct(F.filter(ids, lambda x: x.rlike(r"^[a-z0-9:_-]+$")))


def rule_facts(text: Column) -> Column:
    """array<struct<kind, value>> of what the rules find."""
    t = F.coalesce(text, F.lit(""))

    def found(kind: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(RULES[kind]), 0), lambda x: F.struct(F.lit(kind).alias("kind"), F.btrim(x, F.lit(" (\n\t")).alias("value")))

    return F.concat(*map(found, RULES))


# Words that are no subject of a query.
SUBJECT_STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "am", "be", "been", "being",
    "what", "who", "how", "why", "where", "when", "which", "whom", "whose",
    "this", "that", "these", "those", "of", "for", "to", "from", "in", "on",
    "with", "by", "at", "as", "and", "or", "but", "if", "then", "so",
    "did", "do", "does", "doing", "done", "have", "has", "had", "having",
    "say", "said", "says",
    "can", "could", "may", "might", "must", "should", "would", "will", "shall",
    "i", "you", "your", "yours", "yourself", "yourselves",
    "we", "us", "our", "ours", "they", "them", "their", "theirs",
    "he", "she", "him", "her", "his", "hers", "it", "its",
    "myself", "ourselves", "themselves", "himself", "herself", "itself",
    "user", "users", "agent", "tell", "me", "about", "show", "find", "get",
    "want", "wants", "need", "needs", "like", "likes", "feel", "feels",
)


def subjects(query: Column) -> Column:
    """What a query is about: tokens (of letters, digits, :, _ and -) with a colon as they are, and capitalised ones that are no stop words
    in lower case, sorted."""
    parts = F.filter(F.split(query, r"[^\p{L}\p{N}:_-]+"), lambda t: F.length(t) > 0)
    ids = F.filter(parts, lambda t: t.contains(":"))
    names = F.transform(F.filter(parts, lambda t: t.rlike(r"^\p{Lu}") & ~t.contains(":") & ~F.lower(t).isin(*SUBJECT_STOP_WORDS)), F.lower)
    return F.sort_array(F.array_distinct(F.concat(ids, names)))


def time_decay(valid_from: Column, now: Column, half_life_seconds: Column) -> Column:
    """2 ** -(age / half life), 1 for what is yet to come."""
    age = (F.unix_micros(now) - F.unix_micros(valid_from)) / 1e6
    return F.when(age <= 0, F.lit(1.0)).otherwise(F.exp(-0.6931471805599453 * F.floor(age) / F.greatest(half_life_seconds, F.lit(1))))


def highlight(text: Column, words: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    import re

    found = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)\b({found})\b", f"{before}$1{after}") if words else text
