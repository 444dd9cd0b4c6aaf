"""Text classification, redaction and small text functions as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .rules import java

DETECTION = "struct<category:string,severity:string,reason:string>"
SPACE_RUN = f"[{rules.SPACES}]+"


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def found(text: Column, pattern: str, fold: bool) -> Column:
    """Whether a rule's pattern occurs; the cheap look for a character that it needs comes first."""
    guard, hit = rules.needs(pattern), text.rlike(java(pattern, fold))
    return hit if guard is None else (text.contains("@") if guard == "@" else text.rlike(guard)) & hit


def truthy(c: Column) -> Column:
    """Null for the empty string as well."""
    return F.nullif(c, F.lit(""))


def first_truthy(*cs: Column) -> Column:
    return F.coalesce(*[truthy(c) for c in cs])


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE_RUN, " "))


def severity_of(category: str) -> str:
    return next((s for c, s, _, _ in rules.KEYWORD_RULES if c == category), "HIGH")


def severity(category: Column) -> Column:
    """Severity of a category; HIGH where no rule names it."""
    table = F.create_map(*[F.lit(x) for c, s, _, _ in rules.KEYWORD_RULES for x in (c, s)])
    return F.coalesce(F.try_element_at(table, category), F.lit("HIGH"))


def _detection(category: str, level: str, reason: str) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(level).alias("severity"), F.lit(reason).alias("reason"))


def classify(metadata: Column, value: Column) -> Column:
    """First rule that fits, as struct (category, severity, reason), else null.

    Patterns look at the value, or at the metadata if the value is empty; keywords are substrings of both.
    """
    case = None
    subject = F.coalesce(truthy(value), metadata, F.lit(""))
    source = F.lower(F.concat(F.coalesce(metadata, F.lit("")), F.lit(" "), F.coalesce(value, F.lit(""))))

    def by_keyword(low: Column) -> Column:
        words = None
        for category, level, reason, keys in rules.KEYWORD_RULES:
            hit, what = low.rlike(rules.one_of(keys)), _detection(category, level, reason)
            words = F.when(hit, what) if words is None else words.when(hit, what)
        every = rules.one_of([k for _, _, _, keys in rules.KEYWORD_RULES for k in keys])
        return F.when(low.rlike(every), words)

    for category, pattern, fold in rules.CLASSIFY_PATTERNS:
        hit, what = found(subject, pattern, fold), _detection(category, severity_of(category), "validated pattern")
        case = F.when(hit, what) if case is None else case.when(hit, what)
    return case.otherwise(let(source, by_keyword))


def contains_pii(text: Column) -> Column:
    return classify(F.lit(""), text).isNotNull()


def _replaced(text: Column, patterns, template: str = "<{}_1>") -> Column:
    """Each pattern replaced in turn, where the text has the character that it needs."""
    for category, pattern, fold in patterns:
        step = lambda t, p=java(pattern, fold), r=template.format(category): F.regexp_replace(t, p, r)
        guard = rules.needs(pattern)
        if guard is None:
            text = step(text)
        elif guard == "@":
            text = let(text, _if_contains(guard, step))
        else:
            text = let(text, _if_like(guard, step))
    return text


def _if_contains(what: str, step):
    return lambda t: F.when(t.contains(what), step(t)).otherwise(t)


def _if_like(what: str, step):
    return lambda t: F.when(t.rlike(what), step(t)).otherwise(t)


def sanitize(text: Column) -> Column:
    """The live redaction rules one after another; later rules see what earlier ones wrote.  Null is empty."""
    return _replaced(F.coalesce(text, F.lit("")), rules.REDACT_PATTERNS)


def sanitize_visible(text: Column, names: Column | None = None) -> Column:
    """``sanitize``, then labelled names, dates of birth and addresses, then known names (an array) as whole words."""
    out = _replaced(sanitize(text), rules.VISIBLE_PATTERNS)
    if names is None:
        return out
    pattern = F.concat(F.lit(f"(?i){rules.BOUNDARY}(?:"), F.array_join(F.transform(names, regex_escape), "|"), F.lit(f"){rules.BOUNDARY}"))
    return F.when(F.size(names) > 0, F.regexp_replace(out, pattern, F.lit("<PERSON_1>"))).otherwise(out)


def sanitize_legacy(text: Column) -> Column:
    return _replaced(F.coalesce(text, F.lit("")), rules.LEGACY_PATTERNS)


def sanitize_fallback(text: Column) -> Column:
    return _replaced(F.coalesce(text, F.lit("")), rules.FALLBACK_PATTERNS, "<REDACTED>")


def sums_before(lengths: Column, block: int = 256) -> Column:
    """The sum of what stands before each place of an array of numbers, by sums of blocks: work is nearly in proportion to its size."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    blocks = lambda n: F.sequence(F.lit(0), F.floor(F.size(n) / block).cast("int"))
    whole = lambda n: F.transform(blocks(n), lambda b: add(F.slice(n, b * block + 1, F.lit(block))))
    starts = lambda t: F.transform(t, lambda x, b: add(F.slice(t, F.lit(1), b)))
    inside = lambda n, s: F.transform(n, lambda x, i: F.get(s, F.floor(i / block).cast("int")) + add(F.slice(n, i - i % block + 1, i % block)))
    return let(lengths, lambda n: let(let(whole(n), starts), lambda s: inside(n, s)))


def matches(text: Column, patterns: list[tuple] = rules.MATCH_PATTERNS) -> Column:
    """All matches of the extraction patterns (all of them, or those given) as an array of structs (value, category, severity, start, end).

    Offsets count code points, the end is exclusive; matches of different patterns may overlap.  Each match is
    classified anew, so its category can differ from its pattern's.
    """
    none = F.array().cast("array<struct<value:string,category:string,severity:string,start:int,end:int>>")
    parts = []
    for category, pattern, fold in patterns:
        p = java(pattern, fold)
        both = F.struct(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("v"), F.split(text, p, -1).alias("g"))
        parts.append(F.when(found(text, pattern, fold), let(both, _placed(category))).otherwise(none))
    return F.concat(*parts)


def _placed(category: str):
    """A match starts after the gaps up to its own and the matches before it."""

    def hits(x: Column) -> Column:
        lengths = F.transform(x["v"], lambda v, i: F.length(F.get(x["g"], i)) + F.length(v))
        return let(sums_before(lengths), lambda before: F.transform(x["v"], lambda v, i: _hit(category, v, F.get(before, i) + F.length(F.get(x["g"], i)))))

    return hits


def _hit(category: str, v: Column, start: Column) -> Column:
    d = classify(F.lit(category), v)
    return F.struct(v.alias("value"), d["category"].alias("category"), d["severity"].alias("severity"), start.cast("int").alias("start"), (start + F.length(v)).cast("int").alias("end"))


def _valued(category: str):
    return lambda v: let(classify(F.lit(category), v), lambda d: F.struct(v.alias("value"), d["category"].alias("category"), d["severity"].alias("severity")))


def matched_values(text: Column, patterns: list[tuple] = rules.MATCH_PATTERNS) -> Column:
    """The matches without their places: array of structs (value, category, severity)."""
    none = F.array().cast("array<struct<value:string,category:string,severity:string>>")
    parts = []
    for category, pattern, fold in patterns:
        values = F.regexp_extract_all(text, F.lit(java(pattern, fold)), F.lit(0))
        parts.append(F.when(found(text, pattern, fold), F.transform(values, _valued(category))).otherwise(none))
    return F.concat(*parts)


def label_categories(text: Column) -> Column:
    """Every category one of whose keywords is a substring of the normalised text: array of structs (type, severity)."""

    def hits(plain: Column) -> Column:
        return F.array(*[F.when(plain.rlike("|".join(words)), F.struct(F.lit(c).alias("type"), F.lit(s).alias("severity"))) for c, s, words in rules.LEGACY_LABELS])

    return F.array_compact(let(normalize(text), hits))


def pattern_categories(text: Column) -> Column:
    """Every category of the older patterns that occurs."""
    level = {c: s for c, s, _ in rules.LEGACY_LABELS}
    hits = [F.when(found(text, p, fold), F.struct(F.lit(c).alias("type"), F.lit(level[c]).alias("severity"))) for c, p, fold in rules.LEGACY_PATTERNS]
    return F.array_compact(F.array(*hits))


def normalize(text: Column) -> Column:
    """Lower case; what is not a-z, 0-9 or white space is a space; runs collapse."""
    return collapse(F.regexp_replace(F.lower(text), f"[^a-z0-9{rules.SPACES}]", " "))


def person_name(value: Column) -> Column:
    """The collapsed value if it looks like a name of two to four words, else null."""
    plain = collapse(F.coalesce(value, F.lit("")))
    return F.when(plain.rlike(java(rules.NAME_SHAPE)), plain)


def line_class(line: Column, following: Column) -> Column:
    """Class of a line of a scanned document, which for names depends on the next line."""
    birth = F.coalesce(following, F.lit("")).rlike(java("|".join(rules.LINE_BIRTH), True))

    def judged(value: Column) -> Column:
        low, digit = F.lower(value), value.rlike("[0-9]")
        return (
            F.when(value == "", F.lit(None).cast("string"))
            .when(digit & (value.rlike(java(rules.LINE_GOVERNMENT[0])) | value.rlike(java(rules.LINE_GOVERNMENT[1], True))), "GOVERNMENT_ID")
            .when(low.rlike(java(rules.LINE_BIRTH[0])) | (digit & value.rlike(java(rules.LINE_BIRTH[1]))), "DATE_OF_BIRTH")
            .when(value.rlike(java(rules.LINE_ADDRESS[0], True)) | (digit & value.rlike(java(rules.LINE_ADDRESS[1]))), "ADDRESS")
            .when(value.rlike(java(rules.LINE_PERSON)) & birth, "PERSON")
        )

    return let(collapse(F.coalesce(line, F.lit(""))), judged)


def value_label(text: Column) -> Column:
    """First label of structured values in a text: struct (category, label, at), ``at`` the offset after it."""

    def first(low: Column) -> Column:
        case = None
        for category, pattern in rules.VALUE_LABELS:
            p = java(pattern, True)
            label = F.regexp_extract(text, f"({p})", 1)
            found = F.struct(F.lit(category).alias("category"), label.alias("label"), (F.length(F.split(text, p, 2)[0]) + F.length(label)).alias("at"))
            guard = reduce(or_, [low.contains(w) for w in rules.LABEL_WORDS[category]])
            case = F.when(guard & text.rlike(p), found) if case is None else case.when(guard & text.rlike(p), found)
        return case

    return let(F.lower(text), first)


def intent_tokens(intent: Column) -> Column:
    """Distinct words of three letters or digits and more, without stop words."""
    words = F.regexp_extract_all(F.lower(intent), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in rules.INTENT_STOP_WORDS]))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("... [truncated]")))


def relevant_text(text: Column, tokens: Column, budget: int = 800) -> Column:
    """Sentences that mention most tokens first (ties in order), cut to the budget; short texts stay whole."""
    clean = collapse(F.coalesce(text, F.lit("")))
    chunks = F.split(clean, "(?<=[.!?]) ")
    scored = F.transform(chunks, lambda c, i: F.struct((-F.size(F.filter(tokens, lambda t: F.contains(F.lower(c), t)))).alias("rank"), i.alias("i"), c.alias("c")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("parts"))

    def take(s: Column, x: Column) -> Column:
        part = F.substr(x["c"], F.lit(1), F.greatest(F.lit(0), F.lit(budget) - s["used"]))
        full = (s["used"] >= budget) | (x["c"] == "")
        return F.struct(F.when(full, s["used"]).otherwise(s["used"] + F.length(part) + 1).alias("used"), F.when(full, s["parts"]).otherwise(F.concat(s["parts"], F.array(part))).alias("parts"))

    picked = F.substr(F.array_join(F.aggregate(F.array_sort(scored), start, take)["parts"], " "), F.lit(1), F.lit(budget))
    return F.when(F.length(clean) <= budget, clean).otherwise(picked)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def regex_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"[.*+?^${}()|\[\]\\]", r"\\$0")


def typed_text(text: Column) -> Column:
    """Zero-width characters removed and white space collapsed."""
    return collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{200B}-\x{200D}\x{FEFF}]", ""))


def has_typed_text(text: Column, expected: Column) -> Column:
    return F.contains(typed_text(text), typed_text(expected))


def is_question(intent: Column) -> Column:
    plain = F.regexp_replace(intent, f"^[{rules.SPACES}]+|[{rules.SPACES}]+$", "")
    return plain.rlike(java(rules.QUESTION_START, True)) | plain.rlike(java(rules.QUESTION_FULL, True))


def continuation_intent(intent: Column, done: Column) -> Column:
    """The prompt that goes on after ``done`` steps (array of descriptions): its last eight joined."""
    kept = F.filter(done, lambda d: d.isNotNull() & (d != ""))
    last = F.slice(kept, F.greatest(F.lit(1), F.size(kept) - 7), F.lit(8))
    text = F.coalesce(truthy(F.array_join(last, "; ")), F.lit("the previous phase"))
    rest = ". Read the current sanitized page state as the source of truth. Do not repeat, reopen, navigate back, or search again for completed actions. Return only the remaining steps needed to finish the original request."
    return F.concat(intent, F.lit("\n\nAGENT CONTINUATION: The browser has already completed: "), text, F.lit(rest))
