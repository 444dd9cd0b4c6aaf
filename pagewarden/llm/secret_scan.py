"""Secret scans: candidate strings, then a random forest that removes false positives, with DataFrame functions alone.

The forest is fitted by Spark on labelled findings and then written out as one SQL expression, so that
scanning and redacting are narrow expressions over the text column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the rules.
SECRET_WORDS = "token|secret|key|passw|passwd|pwd|auth|bearer|credential|apikey|private|access"
BENIGN_WORDS = "commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|revision|etag|integrity|version|href|src|blob|tree|base64|image|session|trace|request|build|asset|chunk"
DICTIONARY = "account|address|admin|api|app|asset|author|bundle|button|cache|chunk|class|client|color|config|content|controller|count|data|default|document|element|error|event|example|field|file|font|footer|format|function|general|group|header|image|index|information|item|label|layout|list|main|manager|message|min|model|module|name|number|object|option|page|panel|param|placeholder|product|profile|public|query|release|report|request|response|result|sample|section|server|service|session|static|status|string|style|system|table|template|test|text|title|type|update|user|value|vendor|version|view|widget|your"
FEATURES = ("length", "transitions", "digits", "uppers", "dictionary", "distinct", "hex", "slashes", "path_before", "path_after", "secret_before", "benign_before", "benign_after", "assigned", "dashes", "secret_beside", "benign_beside")


@dataclass(frozen=True)
class CandidateRule:
    """least: characters of a candidate, with a letter and a digit among them; keys of 80 bits take 20 hexadecimal digits, and shorter
    strings are mostly words with a number.  named_least: the same for the value of a telling name (``password = "..."``), which may hold
    some punctuation too.  A candidate never holds its name: "=" is only the padding at its end.  context: characters before and after
    that the forest sees, candidates beside it included; a name, an assignment and a path or word beside it fit in 48.
    """

    least: int = 20
    named_least: int = 8
    context: int = 48

    @property
    def pattern(self) -> str:
        plain, named = "A-Za-z0-9+/_-", "A-Za-z0-9+/_@#$%^&*~-"
        mixed = r"(?=[A-Za-z%s]*+[0-9])(?=[0-9%s]*+[A-Za-z])"
        behind = r"(?<=(?i:%s)[A-Za-z0-9_-]{0,16}[\"']?[ \t]{0,2}[=:][ \t]{0,2}[\"']?)" % SECRET_WORDS
        padding = rf"(?:={{1,2}}(?![={plain}]))?"
        signs = "+/_-", "+/_@#$%^&*~-"
        value = mixed % (signs[1], signs[1]) + behind + "[%s]{%d,}+" % (named, self.named_least)
        token = mixed % (signs[0], signs[0]) + "[%s]{%d,}+" % (plain, self.least)
        return rf"(?<![{plain}])(?:{value}|{token}){padding}"


@dataclass(frozen=True)
class Forest:
    """A fitted forest as a SQL expression of the features; its size is fixed by trees and depth."""

    expression: str
    threshold: float = 0.5


#: A word in the name just before.
BESIDE = r"(?:%s)[a-z0-9_-]*[\"']?\s*[=:]?\s*[\"']?$"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(left: Column, candidate: Column, right: Column) -> Column:
    """Struct of doubles named by FEATURES."""
    n = F.length(candidate).cast("double")
    lower = F.lower(candidate)
    values = [
        n,
        _count(candidate, "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+") / n,
        _count(candidate, "[0-9]") / n,
        _count(candidate, "[A-Z]") / n,
        (n - F.length(F.regexp_replace(lower, DICTIONARY, "")).cast("double")) / n,
        F.size(F.array_distinct(F.split(candidate, ""))).cast("double") / n,
        candidate.rlike("^[0-9a-fA-F]+$").cast("double"),
        _count(candidate, "/"),
        left.rlike(r"[/\\.]$").cast("double"),
        right.rlike(r"^(\.[a-z]|[/\\])").cast("double"),
        _count(F.lower(left), SECRET_WORDS),
        _count(F.lower(left), BENIGN_WORDS),
        _count(F.lower(right), BENIGN_WORDS),
        left.rlike(r"[=:]\s*[\"']?$").cast("double"),
        _count(candidate, "[-_]"),
        F.lower(left).rlike(BESIDE % SECRET_WORDS).cast("double"),
        F.lower(left).rlike(BESIDE % BENIGN_WORDS).cast("double"),
    ]
    return F.struct(*[v.alias(k) for k, v in zip(FEATURES, values, strict=True)])


def labelled_findings(spark: SparkSession, rows: int = 6000, first: int = 0) -> DataFrame:
    """Labelled findings (left, candidate, right, label) made by rule; ``rows`` bounds the training set, other ids are held out of it.

    Even ids are secrets: random strings of several alphabets and short passwords, mostly assigned to a telling name.  Odd ids are false
    positives: commit and file hashes, UUIDs, asset paths, identifiers, embedded images, placeholders, words with a number.  Both come
    quoted, bare and as name=value, and beside words of the other class.
    """
    r = spark.range(first, first + rows, 1, 1)
    kind = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(12))
    hexes, other = F.sha2(F.concat(F.lit("a"), F.col("id").cast("string")).cast("binary"), 256), F.sha1(F.concat(F.lit("b"), F.col("id").cast("string")).cast("binary"))
    b64 = F.regexp_replace(F.base64(F.unhex(F.concat(hexes, other))), r"[\r\n]", "")
    size = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(25)).cast("int")
    words = F.array(*[F.lit(w) for w in DICTIONARY.split("|")])
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(10 + k)), F.size(words)) + 1).cast("int"))
    pick = lambda k, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    plain = F.regexp_replace(b64, "[+/=]", "")
    digest = pick(9, F.substring(hexes, 1, 40), F.substring(other, 1, 40), hexes, F.substring(hexes, 1, 32))
    name, space = pick(13, "", "app_", "DB_", "my-", "x_"), pick(12, "=", " = ", ": ", "=\"", " = \"", ": '")
    telling = F.concat(pick(11, "\n", " ", " export ", "\n- ", "?"), name, pick(4, "token", "SECRET", "secret", "API_KEY", "AWS_SECRET_ACCESS_KEY", "password", "auth_token", "passwd"), space)
    benign = F.concat(pick(11, "\n", " ", " export ", "\n- ", "?"), name, pick(5, "commit", "sha1", "sha256", "checksum", "etag", "revision", "md5", "build", "digest", "version", "tree"), space)
    # A password of letters, some of them changed to digits, and signs.
    short = F.concat(F.initcap(F.translate(F.substr(plain, F.lit(1), F.lit(3) + F.pmod(F.xxhash64("id", F.lit(14)), F.lit(6)).cast("int")), "xyz", "043")), F.substring(other, 1, 2), pick(15, "", "#", "$", "7", "@q"), F.substr(plain, F.lit(20), F.lit(3) + size % 5), F.lit("4z"))
    guessed = pick(16, F.concat(word(6), F.lit("_"), word(7), F.lit("1")), F.concat(word(6), F.lit("12")), F.concat(word(6), word(7), F.lit("2024")), F.lit("example123"), F.lit("your_key_1"), F.lit("changeme1"), F.lit("xxxxxxx1"), F.concat(word(6), F.lit("-"), word(7), F.lit("-1")))
    guessed = F.when(F.length(guessed) < 8, F.concat(guessed, F.lit("_test"))).otherwise(guessed)
    secret = F.when(kind <= 2, F.substring(hexes, 1, 40)).when(kind == 3, hexes).when(kind == 4, F.concat(F.lit("AKIA"), F.upper(F.substring(other, 1, 16)))).when(kind == 5, F.substr(b64, F.lit(1), 24 + size)).when(kind == 8, digest).when(kind == 9, F.substr(b64, F.lit(2), 30 + size % 12)).when(kind >= 10, short)
    secret = secret.otherwise(F.concat(pick(3, "sk_live_", "ghp_", "xoxb-", "pk-", ""), F.substr(plain, F.lit(1), 22 + size)))
    noise = pick(17, " ", " commit ", " checksum and ", " the request ", " ", " ")
    secret_left = F.concat(word(0), noise, word(1), F.when(kind >= 8, telling).otherwise(pick(4, " token = \"", " api_key: '", " secret=", " password = \"", "\nAuthorization: Bearer ", " access key ", "_KEY=", " = \"", " auth_token=\"", " ")))
    false_left = F.when(kind == 0, pick(5, " commit ", " revision ", " tree ")).when(kind == 1, pick(5, " sha256:", " checksum = \"", " integrity=\"sha1-", " md5 digest ")).when(kind == 2, pick(5, " uuid=", " request id ", " session ", " ")).when(kind == 3, pick(5, " src=\"/static/", " href=\"/assets/", " https://example.org/")).when(kind == 4, pick(5, " ", ".", " class=\"")).when(kind == 5, F.lit(" data:image/png;base64,"))
    false_left = F.concat(word(0), pick(18, " ", " token ", " secret and ", " key ", " ", " "), word(1), false_left.when((kind == 8) | (kind == 9), benign).when(kind >= 10, telling).otherwise(pick(5, " token = \"", " key = \"", " ")))
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    false = F.when(kind == 0, F.substring(other, 1, 40)).when(kind == 1, F.substring(hexes, 1, 64)).when(kind == 2, uuid).when(kind == 3, F.concat(word(2), F.lit("/"), word(3), F.lit("/"), word(4), F.lit("-"), F.substring(hexes, 1, 8))).when(kind == 4, F.concat(word(2), F.lit("_"), word(3), F.lit("_"), word(4), F.lit("_"), word(5), F.substring(hexes, 1, 1), F.lit("1"))).when(kind == 5, F.concat(b64, b64)).when((kind == 8) | (kind == 9), digest).when(kind >= 10, guessed)
    false = false.otherwise(F.concat(pick(6, "xxxxxxxxxxxxxxxx", "your_example_value_", "0000000000000000a", "placeholder-example-"), pick(7, "1234", "00000", "9x1111")))
    is_secret = F.pmod(F.col("id"), F.lit(2)) == 0
    right = F.when(is_secret, pick(8, "\" ", "'\n", " ", ";", "\"###", "\n")).otherwise(F.when(kind == 3, pick(8, ".js\" ", ".css", ".png")).otherwise(pick(8, " ", "\" ", "\n", " hash", "'", ";")))
    return r.select(F.when(is_secret, secret_left).otherwise(false_left).alias("left"), F.when(is_secret, secret).otherwise(false).alias("candidate"), right.alias("right"), is_secret.cast("double").alias("label"))


def fit(findings: DataFrame, trees: int = 24, depth: int = 8, seed: int = 5):
    """Spark's random forest on labelled findings (left, candidate, right, label), with the features in one vector."""
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, featureSubsetStrategy="sqrt").fit(assembled(findings))


def assembled(findings: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    rows = findings.select(features(F.col("left"), F.col("candidate"), F.col("right")).alias("f"), "label").select("f.*", "label")
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")


def written(model) -> Forest:
    """A fitted forest as one expression."""
    parts = [_tree(t._call_java("rootNode")) for t in model.trees]
    return Forest("(" + " + ".join(parts) + f") / {len(parts)}.0D")


def train(findings: DataFrame, trees: int = 24, depth: int = 8, seed: int = 5) -> Forest:
    """Fit the forest on labelled findings and write it out as an expression."""
    return written(fit(findings, trees, depth, seed))


def _tree(node) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return f"{stats[1] / max(sum(stats), 1e-9)!r}D"
    split = node.split()
    return f"CASE WHEN x.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D THEN {_tree(node.leftChild())} ELSE {_tree(node.rightChild())} END"


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once for each row, however often later expressions and their lambdas use it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _sums_before(lengths: str, block: int = 256) -> Column:
    """The sums before each place of an array of longs, by sums of blocks: no array grows step by step."""
    blocks = f"transform(sequence(0, size({lengths}) div {block}), b -> aggregate(slice({lengths}, b * {block} + 1, {block}), 0L, (a, x) -> a + x))"
    starts = f"transform(array({blocks}), t -> transform(sequence(0, size({lengths}) div {block}), b -> aggregate(slice(t, 1, b), 0L, (a, x) -> a + x)))[0]"
    return F.expr(f"transform(array({starts}), s -> transform({lengths}, (x, i) -> s[i div {block}] + aggregate(slice({lengths}, (i div {block}) * {block} + 1, i % {block}), 0L, (a, y) -> a + y)))[0]")


def _scan(docs: DataFrame, forest: Forest, rule: CandidateRule) -> tuple[DataFrame, dict[str, str]]:
    """The columns of ``docs`` under names that nothing else has, parts (text between candidates) and found; and the names.

    Columns stay side by side: a struct of them, opened again above the explodes, is more than the optimiser can prune.
    """
    names = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.coalesce(F.col("text"), F.lit("")).alias("t"))
    rows = _once(rows, "parts", F.split("t", rule.pattern, -1))
    rows = _once(rows, "cands", F.regexp_extract_all("t", F.lit(rule.pattern), F.lit(0)))
    rows = _once(rows, "lengths", F.expr("transform(cands, (c, i) -> CAST(length(parts[i]) + length(c) AS BIGINT))"))
    rows = _once(rows, "before", _sums_before("lengths"))
    n = rule.context
    tail = lambda x: f"substr({x}, greatest(1, length({x}) - {n} + 1))"
    left = f"concat({tail('coalesce(get(cands, i - 1), \'\')')}, {tail('parts[i]')})"
    right = f"substr(concat(substr(parts[i + 1], 1, {n}), substr(coalesce(get(cands, i + 1), ''), 1, {n})), 1, {n})"
    rows = _once(rows, "spots", F.expr(f"transform(cands, (c, i) -> struct({left} AS left, c AS candidate, {right} AS right))"))
    cut = lambda x: F.substr(x, F.greatest(F.lit(1), F.length(x) - n + 1))
    rows = _once(rows, "x", F.transform("spots", lambda s: features(cut(s["left"]), s["candidate"], s["right"])))
    rows = _once(rows, "scores", F.expr(f"transform(x, x -> {forest.expression})"))
    found = f"transform(cands, (c, i) -> struct(before[i] + length(parts[i]) AS start, CAST(length(c) AS BIGINT) AS length, scores[i] AS score, scores[i] >= {forest.threshold!r}D AS is_secret, c AS candidate))"
    return _once(rows, "found", F.expr(found)), names


def findings_digest(docs: DataFrame, forest: Forest, rule: CandidateRule = CandidateRule()) -> DataFrame:
    """A row for each candidate: doc_id, start (code points), length, score, is_secret, SHA-256 of the candidate.

    Null and empty texts have no candidates; rows without doc_id and rows that repeat one give their findings each; an empty table
    gives none.  Narrow: nothing is shuffled.  Text is split once, and each candidate costs its own features alone.
    """
    rows, names = _scan(docs.select("doc_id", "text"), forest, rule)
    rows = rows.select(F.col(names["doc_id"]).alias("doc_id"), F.explode("found").alias("f"))
    return rows.select("doc_id", "f.start", "f.length", F.round("f.score", 9).alias("score"), "f.is_secret", F.sha2(F.col("f.candidate").cast("binary"), 256).alias("sha256"))


def redacted(docs: DataFrame, forest: Forest, mask: str = "<SECRET>", rule: CandidateRule = CandidateRule()) -> DataFrame:
    """``docs`` with every secret replaced by ``mask``, false positives left; ``n_chars`` follows where the table has it.

    Null text stays null; rows without doc_id and repeated rows stay, each redacted by itself; an empty table stays empty.
    """
    rebuilt = F.expr(f"array_join(transform(parts, (p, i) -> concat(p, coalesce(CASE WHEN get(found, i).is_secret THEN '{mask}' ELSE get(found, i).candidate END, ''))), '')")
    rows, names = _scan(docs, forest, rule)
    rows = _once(rows, "clean", F.when(F.exists("found", lambda f: f["is_secret"]), rebuilt))
    columns = []
    for c, name in names.items():
        own = F.col(name)
        if c == "text":
            own = F.coalesce("clean", own)
        elif c == "n_chars":
            own = F.when(F.col("clean").isNull(), own).otherwise(F.length("clean").cast(docs.schema[c].dataType))
        columns.append(own.alias(c))
    return rows.select(*columns)
