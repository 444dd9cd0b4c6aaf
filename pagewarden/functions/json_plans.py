"""JSON: leaves of nested values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import plan_steps
from .rules import FALLBACK_PATTERNS, java

#: A string in JSON text: a key if a colon follows, else a value.
STRING_OR_KEY = r'"(?:[^"\\]|\\.)*+"(?:\s*:)?'


def string_values(json: Column) -> Column:
    """All string values at any depth of JSON text, decoded, keys left out; null if it isn't JSON.

    The values are put into one array and read at once, so escapes become the characters that they stand for.
    """
    strings = F.filter(F.regexp_extract_all(json, F.lit(STRING_OR_KEY), F.lit(0)), lambda s: ~s.endswith(":"))
    decoded = F.from_json(F.concat(F.lit("["), F.array_join(strings, ","), F.lit("]")), "array<string>")
    return F.when(F.try_parse_json(json).isNotNull(), F.coalesce(decoded, strings))


def contains_raw_pii(json: Column) -> Column:
    """Whether any string value at any depth has an e-mail, phone, card or identity shape."""
    hit = lambda v: v.rlike("|".join(f"(?:{java(p, fold)})" for _, p, fold in FALLBACK_PATTERNS))
    return F.coalesce(F.exists(string_values(json), hit), F.lit(False))


def tab_selected(scope: Column, number: Column, pinned: Column, current: Column, numbers: Column, start: Column, end: Column) -> Column:
    """Whether a tab (numbered from 1) falls under a closing scope; a range may be given in either order."""
    return (
        F.when(scope == "all_except_current", ~current)
        .when(scope == "all_unpinned_except_current", ~current & ~pinned)
        .when(scope == "tab_numbers", F.array_contains(numbers, number.cast("int")))
        .when(scope == "tab_range", number.between(F.least(start, end), F.greatest(start, end)))
        .otherwise(F.lit(False))
    )


# Captures of an intent's first line.
MEDIA = r"(?i)\b(play|watch|listen(?:\s+to)?)\s+(.+?)\s*$"
SEARCH = r"(?i)\b(?:search(?:\s+for)?|find|look\s+up|open)\s+(.+?)\s+(?:on|in|at)\s+(youtube(?:\s+music)?|yt|google|github|wikipedia|wiki|amazon)\b"


# What tells a command to close tabs, and one to search.
TAB_VERB, TAB_NOUN = r"\b(?:close|remove|delete)\b", r"\btabs?\b"
TAB_OTHERS = r"\b(?:all|other|rest|remaining)\s+tabs?\b"
TAB_KEPT = r"\b(?:except|but|keep|retain|leave)\b.*\b(?:current|this|one)\s+tab\b|\bonly\s+keep\s+(?:this|current|one|\d+)\s+tab\b"
TAB_SPAN = r"\btabs?\s+(\d+)\s*(?:to|through|-)\s*(\d+)\b"
TAB_LIST = r"\btabs?\s+((?:\d+\s*(?:,|and|&)?\s*)+)\b"
OTHER_SOURCE = r"(?i)\s+(?:on|in)\s+[a-z0-9 .-]+\s*$"
MEDIA_TAIL = r"(?i)\s+(?:on|in)\s+youtube(?:\s+music)?\s*$"
ACTS = r"\b(?:click|play|watch|listen|add|put|buy|purchase|cart|basket|bag|compare|select|details?|review)\b"
OPENS, NEW_TAB = r"\bopen\s+(?!a?\s*new\s+tab\b)(?!.*\bsearch\b)", r"\bnew\s+tab\b"
COMPOSER = "new message|to recipients|subject|message body"
# End of the fixed values.


# ---- Plans of browser steps ----
# The vocabulary of steps.
ACTIONS = ["click", "dblclick", "rightclick", "type", "key", "select", "scroll", "wait", "navigate", "opentab", "closetabs", "hover", "focus", "clear", "drag", "screenshot"]
TARGETED = ["click", "dblclick", "rightclick", "type", "select", "hover", "focus", "clear"]
SCOPES = ["all_except_current", "all_unpinned_except_current", "tab_numbers", "tab_range"]
RESPONSE_TYPES = ["answer", "tasks", "mixed"]
# End of the fixed values.


def extract_json(raw: Column) -> Column:
    """JSON text in noisy output: what a fence holds, else from the first brace to the last; null if there is none."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    first, tail = F.instr(raw, "{"), F.regexp_extract(raw, r"(?s)^(.*\})", 1)
    bare = F.when((first > 0) & (F.length(tail) >= first), F.substr(tail, first))
    return F.coalesce(F.nullif(fenced, F.lit("")), bare)


def parse_plan(raw: Column, intent: Column) -> Column:
    """Struct of a plan from raw output: ``error`` (null if it is valid) and, if valid, type, answer, flags, intent and the steps as JSON texts.

    Checks come in a fixed order; a step's number or size that is no integer is an error of its own, apart from
    the faults that a retry could mend.
    """
    j = extract_json(raw)
    get = lambda p: F.get_json_object(j, f"$.{p}")
    valid = F.try_parse_json(j).isNotNull()
    raw_tasks = get("tasks")
    absent = raw_tasks.isNull() | raw_tasks.isin("", "0", "false", "{}", "[]")
    steps = F.when(absent, F.array().cast("array<string>")).otherwise(F.from_json(raw_tasks, "array<string>"))
    kind, answer = F.coalesce(get("type"), F.lit("tasks")), F.trim(F.coalesce(get("answer"), F.lit("")))
    shot = ~F.coalesce(get("requires_screenshot"), F.lit("false")).isin("false", "0", "", "[]", "{}")
    s = F.struct(valid.alias("valid"), j.alias("j"), kind.alias("kind"), answer.alias("answer"), shot.alias("shot"), absent.alias("absent"), (~absent & ~raw_tasks.startswith("[")).alias("not_list"), steps.alias("steps"), intent.alias("asked"))

    def judged(x: Column) -> Column:
        n = F.size(x["steps"])
        faults = F.filter(F.transform(x["steps"], lambda t, i: _first_fault(t)), lambda e: e.isNotNull())
        error = (
            F.when(x["j"].isNull(), "NO_JSON")
            .when(~x["valid"], "INVALID_JSON")
            .when(~x["kind"].isin(*RESPONSE_TYPES), "BAD_TYPE")
            .when(x["not_list"], "TASKS_NOT_LIST")
            .when(x["shot"] & (n > 0), "SCREENSHOT_WITH_TASKS")
            .when(~x["shot"] & (x["kind"] == "answer") & (x["answer"] == ""), "EMPTY_ANSWER")
            .when(~x["shot"] & (x["kind"] == "answer") & (n > 0), "ANSWER_WITH_TASKS")
            .when(~x["shot"] & (x["kind"] == "mixed") & ((x["answer"] == "") | (n == 0)), "MIXED_INCOMPLETE")
            .when(~x["shot"] & (x["kind"] == "tasks") & (n == 0), "EMPTY_TASKS")
            .otherwise(F.get(faults, F.lit(0)))
        )
        flag = lambda p, d: F.coalesce(F.get_json_object(x["j"], f"$.{p}"), d) == "true"
        return F.struct(error.alias("error"), x["kind"].alias("type"), x["answer"].alias("answer"), flag("task_complete", F.when(x["kind"] == "answer", "true").otherwise("false")).alias("task_complete"), flag("requires_confirmation", F.lit("false")).alias("requires_confirmation"), x["shot"].alias("requires_screenshot"), F.coalesce(F.nullif(F.get_json_object(x["j"], "$.intent"), F.lit("")), x["asked"]).alias("intent"), x["steps"].alias("steps"))

    return F.transform(F.array(s), judged)[0]


def _first_fault(step: Column) -> Column:
    """The fault of one step's JSON text."""
    return F.element_at(F.transform(F.array(step), lambda t: _fault_of(t)), 1)


def _fault_of(t: Column) -> Column:
    v = lambda p: F.get_json_object(t, f"$.{p}")
    is_object = lambda x: F.trim(x).startswith("{")
    number_fault = lambda name: plan_steps.whole_number(t, name, F.lit(0))["fault"]
    positive = lambda x: F.coalesce(x.rlike("^[1-9][0-9]*$"), F.lit(False))
    act, scope = F.coalesce(v("action"), F.lit("")), F.coalesce(F.nullif(v("scope"), F.lit("")), F.lit("all_except_current"))
    target_ok, origin = v("target").isNull() | is_object(v("target")), F.coalesce(v("from"), v("source"))
    return (
        F.when(~is_object(t), "STEP_NOT_OBJECT")
        .when(~act.isin(*ACTIONS), "UNKNOWN_ACTION")
        .when(number_fault("step").isNotNull(), number_fault("step"))
        .when(act.isin(*TARGETED, "drag", "key", "scroll") & ~target_ok, "TARGET_NOT_OBJECT")
        .when((act == "drag") & origin.isNotNull() & ~is_object(origin), "TARGET_NOT_OBJECT")
        .when(act.isin("type", "select") & v("value").isNull(), "VALUE_REQUIRED")
        .when((act == "scroll") & number_fault("pixels").isNotNull(), number_fault("pixels"))
        .when((act == "wait") & number_fault("timeout_ms").isNotNull(), number_fault("timeout_ms"))
        .when(act.isin("navigate", "opentab") & (F.coalesce(v("url"), F.lit("")) == ""), "URL_REQUIRED")
        .when((act == "closetabs") & ~scope.isin(*SCOPES), "BAD_SCOPE")
        .when((act == "closetabs") & (scope == "tab_numbers") & ~F.coalesce(v("tab_numbers").rlike(r"^\[[1-9][0-9]*(,[1-9][0-9]*)*\]$"), F.lit(False)), "BAD_TAB_NUMBERS")
        .when((act == "closetabs") & (scope == "tab_range") & ~(positive(v("tab_range.start")) & positive(v("tab_range.end"))), "BAD_TAB_RANGE")
    )


def second_verdict(plan: Column) -> Column:
    """The stricter check before execution, on a plan's JSON text: error code, null if it may run."""
    get = lambda p: F.get_json_object(plan, f"$.{p}")
    steps = F.from_json(get("tasks"), "array<string>")
    s = F.struct(plan.alias("p"), get("tasks").alias("raw"), steps.alias("steps"), (F.coalesce(get("type"), F.lit("")).isin("answer", "mixed") | (F.coalesce(get("answer"), F.lit("")) != "")).alias("answers"))

    def fault(t: Column) -> Column:
        v = lambda p: F.get_json_object(t, f"$.{p}")
        act = F.coalesce(v("action"), F.lit(""))
        located = (F.coalesce(v("target.elementId"), v("target.selector"), v("target.rect"), F.lit("")) != "") & F.coalesce(v("target"), F.lit("")).startswith("{")
        return (
            F.when(~act.isin(*ACTIONS), "UNKNOWN_ACTION")
            .when(~F.coalesce(v("step").rlike("^[1-9][0-9]*$"), F.lit(False)), "BAD_STEP")
            .when(act.isin(*TARGETED) & ~located, "TARGET_REQUIRED")
            .otherwise(_fault_of(t))
        )

    def judged(x: Column) -> Column:
        n = F.size(x["steps"])
        return (
            F.when(~F.coalesce(F.trim(x["p"]).startswith("{"), F.lit(False)), "NOT_OBJECT")
            .when(~F.coalesce(x["raw"].startswith("["), F.lit(False)), "NO_TASKS")
            .when((n == 0) & ~x["answers"], "EMPTY_TASKS")
            .when(n > 50, "TOO_MANY_STEPS")
            .otherwise(F.get(F.filter(F.transform(x["steps"], lambda t: fault(t)), lambda e: e.isNotNull()), F.lit(0)))
        )

    return F.transform(F.array(s), judged)[0]


def privacy_gate(state: Column) -> Column:
    """Whether a state's JSON text proves itself clean: sanitized is true, a raw picture is false (both booleans, present),
    and the redaction map, if there is one, is a list."""
    get = lambda p: F.get_json_object(state, f"$.privacy.{p}")
    parsed = F.try_parse_json(state)
    kind = lambda p: F.schema_of_variant(F.try_variant_get(parsed, f"$.privacy.{p}", "variant"))
    boolean = (kind("sanitized") == "BOOLEAN") & (kind("rawScreenshotIncluded") == "BOOLEAN")
    listed = get("redactionMap").isNull() | get("redactionMap").startswith("[")
    return F.coalesce(boolean & (get("sanitized") == "true") & (get("rawScreenshotIncluded") == "false") & listed, F.lit(False))


def response_text(response: Column) -> Column:
    """The text of a model's response: output_text, else the parts of its steps, else of its outputs."""
    get = lambda p: F.nullif(F.get_json_object(response, p), F.lit(""))
    parts = lambda p: F.nullif(F.array_join(F.from_json(F.get_json_object(response, p), "array<string>"), ""), F.lit(""))
    return F.coalesce(get("$.output_text"), parts("$.steps[*].content[*].text"), get("$.steps[0].content[0].text"), parts("$.outputs[*].text"), get("$.outputs[0].text"))


def needs_fresh_plan(plan: Column) -> Column:
    """Whether a plan's only step leads to a page that has to be looked at before going on."""
    step = lambda p: F.coalesce(F.get_json_object(plan, f"$.tasks[0].{p}"), F.lit(""))
    n = F.coalesce(F.size(F.from_json(F.get_json_object(plan, "$.tasks"), "array<string>")), F.lit(0))
    url, moves = F.lower(step("url")), step("action").isin("navigate", "opentab")
    results = moves & ((url.contains("youtube.com/results") & url.contains("search_query=")) | (url.contains("google.") & url.contains("/search")))
    enter = (step("action") == "key") & (F.lower(F.coalesce(F.nullif(step("key"), F.lit("")), step("value"))) == "enter")
    return (n == 1) & ((F.coalesce(F.get_json_object(plan, "$.task_complete"), F.lit("")) == "false") | results | enter)


def first_line(intent: Column) -> Column:
    return F.split_part(intent, F.lit("\n"), F.lit(1))


def tab_command(intent: Column) -> Column:
    """Struct (scope, numbers, start, end) of an explicit command to close tabs, else null."""
    line = F.lower(first_line(intent))
    asked = line.rlike(TAB_VERB) & line.rlike(TAB_NOUN)
    others = line.rlike(TAB_OTHERS) & line.rlike(TAB_KEPT)
    listed = F.regexp_extract(line, TAB_LIST, 1)
    numbers = F.filter(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(listed, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int")))), lambda x: x > 0)
    none = F.array().cast("array<int>")
    made = lambda scope, ns=none, a=F.lit(None).cast("int"), b=F.lit(None).cast("int"): F.struct(scope.alias("scope"), ns.alias("numbers"), a.alias("start"), b.alias("end"))
    keep = F.when(line.contains("pinned"), "all_unpinned_except_current").otherwise("all_except_current")
    return (
        F.when(asked & others, made(keep))
        .when(asked & line.rlike(TAB_SPAN), made(F.lit("tab_range"), none, F.regexp_extract(line, TAB_SPAN, 1).try_cast("int"), F.regexp_extract(line, TAB_SPAN, 2).try_cast("int")))
        .when(asked & (F.size(numbers) > 0), made(F.lit("tab_numbers"), numbers))
    )


def direct_search(intent: Column, page_url: Column) -> Column:
    """Struct (site, query, action, url, task_complete) of a request that can go straight to a site's results, else null."""
    from .urls import ALIASES, ROUTES, results_site, search_url

    line = first_line(intent)
    low = F.lower(line)
    named = F.coalesce(*[F.when(low.rlike(rf"\b{name}\b"), name) for name, _, _ in ROUTES], *[F.when(low.contains(a), to) for a, to in ALIASES])
    media, explicit = F.regexp_extract(line, MEDIA, 2), F.regexp_extract(line, SEARCH, 1)
    other_source = media.rlike(OTHER_SOURCE) & named.isNull()
    wanted = F.lower(F.regexp_extract(line, SEARCH, 2))
    alias = F.coalesce(*[F.when(wanted == a, to) for a, to in ALIASES], wanted)
    is_media = media != ""
    site = F.when(is_media, F.coalesce(named, F.lit("youtube"))).when(explicit != "", alias)
    query = F.when(is_media, F.regexp_replace(media, MEDIA_TAIL, "")).otherwise(explicit)
    query = F.regexp_replace(query, r"^[ .,!?\"]+|[ .,!?\"]+$", "")
    acts = is_media | low.rlike(ACTS) | low.rlike(OPENS)
    skip = intent.contains("AGENT CONTINUATION:") | (is_media & other_source) | (results_site(F.coalesce(page_url, F.lit(""))) == site) | (query == "")
    known = site.isin(*[name for name, _, _ in ROUTES])
    action = F.when(F.lower(intent).rlike(NEW_TAB), "opentab").otherwise("navigate")
    return F.when(F.coalesce(known, F.lit(False)) & ~F.coalesce(skip, F.lit(False)), F.struct(site.alias("site"), query.alias("query"), action.alias("action"), search_url(site, query).alias("url"), (~acts).alias("task_complete")))


def stale_plan(intent: Column, page_url: Column, visible: Column, plan: Column, elements: Column | None = None) -> Column:
    """Error code of a continuation that starts over on a results page or in a mail editor, else null.

    ``elements`` is the JSON array of the page's elements; with it, only typing into one that is editable fills an open editor,
    and their texts, labels, placeholders and roles count as text of the page.  Without it every type step does.
    """
    from .urls import host, results_site

    steps = F.from_json(F.get_json_object(plan, "$.tasks"), "array<string>")
    get = lambda t, p: F.coalesce(F.get_json_object(t, f"$.{p}"), F.lit(""))
    any_of = lambda *a: F.exists(steps, lambda t: get(t, "action").isin(*a))
    says_search = F.exists(steps, lambda t: F.lower(get(t, "description")).contains("search"))
    again = any_of("type", "key", "navigate", "opentab") | says_search | ~any_of("click", "dblclick")
    low = F.lower(F.coalesce(visible, F.lit("")))
    typing = any_of("type")
    if elements is not None:
        listed = F.from_json(elements, "array<string>")
        told = F.flatten(F.transform(listed, lambda e: F.array(*[get(e, c) for c in ("text", "label", "placeholder", "role")])))
        low = F.concat_ws(" ", low, F.lower(F.array_join(told, " ")))
        able = lambda e: ~F.coalesce(F.get_json_object(e, "$.editable"), F.lit("")).isin("", "false", "0", "[]", "{}") & (get(e, "elementId") != "")
        editors = F.coalesce(F.transform(F.filter(listed, able), lambda e: get(e, "elementId")), F.array().cast("array<string>"))
        typing = F.exists(steps, lambda t: (get(t, "action") == "type") & F.array_contains(editors, get(t, "target.elementId")))
    composing = host(page_url).contains("mail.google.com") & low.rlike(COMPOSER)
    tabs = F.exists(steps, lambda t: (get(t, "action") == "key") & (F.lower(F.coalesce(F.nullif(get(t, "key"), F.lit("")), get(t, "value"))) == "tab"))
    return (
        F.when(~intent.contains("AGENT CONTINUATION:"), F.lit(None).cast("string"))
        .when(results_site(page_url).isNotNull() & again, "ALREADY_ON_RESULTS")
        .when(composing & any_of("navigate", "opentab"), "COMPOSER_OPEN")
        .when(composing & (tabs | ~typing), "COMPOSER_NEEDS_TYPE")
    )
