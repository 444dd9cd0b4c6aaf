"""Each operator against a plain version, on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import cap_filters, components, language_codes, line_quality, ngram_join, pieces, secret_scan, source_mix, suffix_dedup, token_files, warc_bundles
from pagewarden.llm._shared import shared_dir

from . import brute

tokenizers_ = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, key string, n long, pack long, keys string, component long, hashes string"


def texts() -> list[tuple]:
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["th", "er", "ing", "an", "to", "ré", "ß"]) for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(120)) for _ in range(6)]
    out = [(0, base[0]), (1, base[0]), (2, None), (3, ""), (4, " \n\t "), (5, "two words"), (6, "Two WORDS"), (7, base[1] + "\n" + base[1]), (8, "a" * 300), (9, "ab " * 200)]
    for k in range(10, 30):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 2, 6])):
            words[rng.randrange(len(words))] = word()
        out.append((k, rng.choice(["", "Common line here.\n"]) + " ".join(words)))
    out.append((30, " ".join(word() for _ in range(30_000))))
    out.append((31, base[2] + ' token = "' + hashlib.sha1(b"x").hexdigest() + '" ' + base[3]))
    return out


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = [(None, rows[0][1]), rows[5], rows[5]]  # no identifier, and repeated rows
    data = [(i, t, None if i == 3 else "en" if (i or 0) % 2 else "fr", None if i == 2 else f"s{(i or 0) % 3}", "k", 1, 2, "x", 3, "h") for i, t in rows + more]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_dedup(rows, docs, empty):
    every = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute.dedup(every, 50)
    got = suffix_dedup.dedup_digest(docs).collect()
    assert len(got) == len(every)
    for r in got:
        options = {v for (i, _), v in want.items() if i == r.doc_id}
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in options
    assert suffix_dedup.dedup_digest(empty).count() == 0


def phrase_rows() -> list[tuple]:
    """One phrase in a third of all documents, each time in other surroundings, among texts that repeat."""
    rng, phrase = random.Random(21), "the very same words in so many documents"
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    rows = []
    for k in range(600):
        text = " ".join(word() for _ in range(30))
        rows.append((k, f"{text[:90]} {phrase} {text[90:]}" if k % 3 == 0 else text))
    return [*rows, *[(600 + k, rows[9 * k][1]) for k in range(60)], (700, phrase * 5), (701, "x" * 120), (702, "x" * 90)]


@pytest.mark.parametrize("hot_packs, many", [(0, 1), (2, 1), (1, 4)])
def test_suffix_dedup_of_hot_keys(spark, hot_packs, many):
    rows = phrase_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rule = suffix_dedup.DedupRule(hot_packs=hot_packs, many=many)
    table = suffix_dedup.packs.staged_packs(frame, shared_dir(spark), pack_bytes=8000)
    got = suffix_dedup.marks(table, rule, suffix_dedup._digest, suffix_dedup.SPAN_SCHEMA).collect()
    want = {i: v for (i, _), v in brute.dedup(rows, 50).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_keys_with_many_surroundings():
    phrase, word = b"the very same words in so many documents", "{:06x} surroundings of its own {:06x}"
    texts = [word.format(k * 7919, k).encode() + phrase + word.format(k, k * 104729).encode() for k in range(12)]
    texts += [b"a passage that comes with all that stands around it, long enough for windows of its own" for _ in range(12)]
    data = b"".join(texts)
    row = type("Row", (), {})()
    row.pack, row.n_docs, row.n_bytes = 0, len(texts), len(data)
    row.doc_ids, row.known = np.arange(len(texts), dtype="<i8").tobytes(), np.ones(len(texts), np.uint8).tobytes()
    row.lengths = np.asarray([len(t) for t in texts], "<i8").tobytes()
    import zstandard

    row.body = zstandard.ZstdCompressor().compress(data)
    pack = suffix_dedup.packs.Pack(row)
    keys, first, size, doc = suffix_dedup.all_runs(pack, 50)
    varied = suffix_dedup.varied_keys(pack.data, keys, first, size, 50, 8)
    own = {k: set() for k in keys.tolist()}
    for k, a, n in zip(keys.tolist(), first.tolist(), size.tolist(), strict=True):
        own[k].add(data[a : a + n + 49])
    assert varied.tolist() == sorted(k for k, ts in own.items() if len(ts) >= 8) and len(varied)
    assert not set(varied.tolist()) & set(keys[doc >= 12].tolist())


def test_no_key_of_a_hot_phrase_gathers(spark):
    """The phrase's key alone would bring a text for each document together; split by windows, no key has more than a few."""
    import collections

    frame = spark.createDataFrame([r for r in phrase_rows() if r[0] % 3 == 0 and r[0] < 600], "doc_id long, text string").repartition(3)
    table = suffix_dedup.packs.staged_packs(frame, shared_dir(spark), pack_bytes=8000).collect()
    most = {}
    for hot in (False, True):
        texts = collections.Counter()
        for row in table:
            pack = suffix_dedup.packs.Pack(row)
            keys = np.unique(suffix_dedup.all_runs(pack, 50)[0])
            r = suffix_dedup.Runs(pack, keys, keys if hot else keys[:0], 50)
            texts.update(r.keys.tolist())
        most[hot] = max(texts.values())
    assert most[False] >= 150 and most[True] <= 20


def test_suffix_spans_rebuild_the_rest(rows, docs):
    by_id = dict(rows)
    for r in suffix_dedup.dedup(docs).filter("doc_id IS NOT NULL").collect():
        data = (by_id[r.doc_id] or "").encode()
        left, at = b"", 0
        for a, b in r.spans:
            left, at = left + data[at:a], b
        assert left + data[at:] == bytes(r.kept)


@pytest.mark.parametrize("shallow", [8, 16, 32, 48])
def test_deep_shallow_sorting_finds_equal_windows(shallow):
    rng = random.Random(shallow)
    groups = [bytes(rng.choice(b"ab") for _ in range(70)) for _ in range(8)] + [b"ab" * 40, b"ba" * 40]
    keys, owners = np.asarray([k % 3 for k in range(len(groups))], np.uint64), np.asarray([rng.randint(0, 99) for _ in groups])
    got = suffix_dedup.least_owner(keys, groups, owners, suffix_dedup.DedupRule(shallow=shallow))
    for k, t in enumerate(groups):
        for w in range(len(t) - 49):
            assert got[k][w] == min(owners[j] for j, u in enumerate(groups) if keys[j] == keys[k] and t[w : w + 50] in u)


def test_blind_trie_orders_its_strings():
    rng = random.Random(1)
    data = bytes(rng.choice(b"abc") for _ in range(400))
    trie = suffix_dedup.BlindTrie(data, 50)
    for k in range(351):
        trie.add(k, k)
    order = [i for leaf in trie.leaves() for i in leaf]
    assert [data[i : i + 50] for i in order] == sorted(data[i : i + 50] for i in range(351))


def test_warc_round_trip(spark):
    big = "x" * 1500
    pages = spark.createDataFrame([(1, "http://a", big, 0), (2, None, big, 0), (3, "http://c\r\nEvil: 1", "small", 0), (4, "u", "small", 0), (5, "u", None, 0), (None, "u", big, 0), (2, None, big, 0)], "page_id long, url string, html string, key int")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc_bundles.archive_digest(pages).collect()}
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert got == {(1, "revisit", 2, 1500, sha(big)), (2, "response", None, 1500, sha(big)), (3, "response", None, 5, sha("small")), (4, "response", None, 5, sha("small")), (5, "response", None, 0, sha("")), (None, "response", None, 1500, sha(big))}
    assert warc_bundles.archive_digest(pages.filter("page_id = 99")).count() == 0


def plain_archive(rows: list[tuple]) -> list[tuple]:
    """(page_id, url, html) by the contract alone."""
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, d in data:
        same = [j for j, e in data if e == d and j is not None] if len(d) >= 1000 and i is not None else []
        to = max(same) if same and max(same) != i else None
        out.append((i, len(d), hashlib.sha1(d).hexdigest(), "response" if to is None else "revisit", to))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_warc_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    bodies = ["", None, "é" * 499, "é" * 500, "x" * 999, "y" * 1000, "\r\n\r\n" * 300, "WARC/1.1\r\n" * 120, "z" * 300_000]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "http://h/a b", "u\r\nx: y"]), rng.choice(bodies)) for _ in range(80)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = warc_bundles.archive_digest(frame, frame_bytes=3000, bundle_bytes=2000).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(plain_archive(rows), key=key)


def test_bundles_are_read_over_many_tasks(spark):
    pages = spark.createDataFrame([(k, "u", "x" * k) for k in range(200)], "page_id long, url string, html string").repartition(12)
    index = warc_bundles.write_bundles(pages, shared_dir(spark) + "/b").cache()
    assert index.select("path").distinct().count() >= 4
    back = warc_bundles.read_bundles(spark, index).select("page_id", F.spark_partition_id().alias("p"))
    assert back.select("p").distinct().count() >= 3
    index.unpersist()


def test_warc_random_access(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "né" * (k * 50)) for k in range(40)], "page_id long, url string, html string")
    index = warc_bundles.write_bundles(pages, shared_dir(spark) + "/b", frame_bytes=2000).cache()
    assert index.agg(F.max("frame")).first()[0] > 0
    for row in index.filter("page_id IN (0, 7, 39)").collect():
        record = warc_bundles.read_record(row.asDict())
        assert record["page_id"] == row.page_id and record["payload"] == ("né" * (row.page_id * 50)).encode()
    with warc_bundles.reading(index.first().path) as source:
        assert len(warc_bundles.BundleReader(source).record_map()) > 0
    index.unpersist()


def test_line_quality_common_lines_deplete(spark, docs, empty):
    line = "this one line is in very many documents of the host and has many words in it to be sure"
    own = [(k, (line + "\n") * 4 if k < 30 else " ".join(f"w{k}x{j}" for j in range(80)), "h") for k in range(60)]
    got = {r.doc_id: r for r in line_quality.quality_digest(spark.createDataFrame(own, "doc_id long, text string, source string")).collect()}
    assert not any(got[k].kept for k in range(30)) and all(got[k].kept for k in range(30, 60))
    edge = line_quality.quality_digest(docs).collect()
    assert len(edge) == docs.count()
    null = next(r for r in edge if r.doc_id == 2)
    assert (null.n_words, null.base_failed, null.kept) == (0, True, False)
    assert line_quality.keep_good(docs).columns == docs.columns
    assert line_quality.quality_digest(empty).count() == 0


def test_line_quality_of_more_distinct_words_than_a_code_holds():
    text = " ".join(f"{k:x}" for k in range((1 << 21) + 10)) + " g h i g h i"
    codes = {}
    assert line_quality.text_stats(text, codes)[4] == 6 and line_quality.text_stats("x y z u", codes)[4] == 0


#: Names that the operators use themselves.
OWN_NAMES = ["row", "host", "common", "removed", "s", "v", "n_blocks", "passes", "cut_block", "cut_doc", "_source", "_block", "epoch", "block", "parts", "cands", "lengths", "before", "spots", "x", "scores", "found", "clean", "own", "key", "a.b"]


def test_columns_with_the_operators_own_names(spark):
    forest = secret_scan.Forest("1.0D")
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{words} {hashlib.sha1(bytes([k])).hexdigest()}", "s", *[f"{c}{k}" for c in OWN_NAMES]) for k in range(3)] + [(None, None, None, *OWN_NAMES)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in OWN_NAMES))
    for got in (line_quality.keep_good(frame), source_mix.mixed(frame, source_mix.MixTarget(budget_ratio=1.0)), secret_scan.redacted(frame, forest), ngram_join.keep_first(frame)):
        assert got.columns == frame.columns
        seen = {r.doc_id: r for r in got.collect()}
        assert {0, 1, 2} & set(seen) and all(r[c] == f"{c}{k}" for k, r in seen.items() if k is not None for c in OWN_NAMES)
    assert all("<SECRET>" in r.text for r in secret_scan.redacted(frame, forest).collect() if r.text)


def test_source_mix_meets_its_target(spark, docs, empty):
    rng = random.Random(3)
    own = [(k, " ".join("w" for _ in range(rng.randint(1, 40))), "big" if k % 10 < 7 else f"s{k % 3}") for k in range(600)]
    frame = spark.createDataFrame(own, "doc_id long, text string, source string")
    target = source_mix.MixTarget(block_tokens=300, max_repeats=3.0)
    plan = {r._source: r for r in source_mix.plan(source_mix.counted(frame), target).collect()}
    w = np.asarray([r.weight for r in plan.values()])
    assert abs(w.sum() - 1) < 1e-9 and -(w * np.log(w)).sum() >= 0.95 * np.log(len(w)) - 1e-9
    got = source_mix.mix_digest(frame, target).collect()
    for s, r in plan.items():
        taken = sum(x.n_tokens for x in got if x.source == s)
        assert r.budget - 40 <= taken <= r.budget and taken <= 3.0 * r.tokens + 1e-6
    assert len({(x.doc_id, x.epoch) for x in got}) == len(got)
    assert source_mix.mixed(docs).columns == docs.columns and source_mix.mix_digest(empty).count() == 0


def test_token_files(spark, rows, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizers_.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    every = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for i, t in every:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.token_digest(docs, path, file_tokens=5000).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_digest(empty, path).count() == 0


class Bytes:
    """An open file that counts what is read of it."""

    def __init__(self, data: bytes):
        self.data, self.read = data, 0

    def read_at(self, n: int, at: int) -> bytes:
        self.read += n
        return self.data[at : at + n]


def test_token_file_random_access():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 70_000, 50_000).astype("<u4")
    source = Bytes(token_files.pack(ids, np.asarray([1, 2]), np.asarray([0, 2000, 50_000])))
    file = token_files.TokenFile(source)
    source.read = 0
    assert all(file.token(k) == ids[k] for k in (0, 511, 512, 513, 4095, 49_999)) and source.read < 6 * 3 * 80
    assert (file.document(0) == ids[:2000]).all() and (file.document(1) == ids[2000:]).all() and len(file.slice(7, 7)) == 0


def test_words_have_the_ids_of_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizers_.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    cache = token_files.WordCache(lib, limit=300)
    bits = ["foo", "Bär", "é", "ñandú", "x9", "12", ",", ".", "!?", "'s", "don't", "\n", "\n\n", "\t", " ", "  ", "-", "(", '"', "<|endoftext|>", "ǅ", "日本", "\u00a0", "½", "😀", "_", "\r\n", "a" * 70, "\x00"]
    for _ in range(300):
        texts = ["".join(rng.choice(bits) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 12))) for _ in range(5)]
        for text, got in zip(texts, cache.ids(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text
    long = "".join(rng.choice(bits) + rng.choice(["", "", " "]) for _ in range(60_000))
    assert np.frombuffer(cache.ids([long])[0], "<u4").tolist() == lib.encode(long, add_special_tokens=False).ids


def test_language_codes(spark, docs, empty):
    word = {"aa": ["kata", "lopa", "mira"], "bb": ["xiq", "zuq", "wex"], "cc": ["őűt", "áéí", "űő"]}
    rng = random.Random(4)
    own = [(k, " ".join(rng.choice(word[lang]) for _ in range(30)), lang) for k in range(300) for lang in [rng.choice(["aa", "bb", "cc"])]] + [(900, None, "aa"), (901, "123 !? ½ ² Ⅷ", "bb"), (None, "kata lopa", None)]
    got = {r.doc_id: r for r in language_codes.language_digest(spark.createDataFrame(own, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in own[:300] if got[k].held_out)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[None].lang_pred == "aa" and not got[None].held_out
    assert all((zlib.crc32(str(k).encode()) % 4 == 2) == got[k].held_out for k in range(300))
    model = language_codes.train(spark.createDataFrame(own, "doc_id long, text string, lang string"), rows=40)
    assert model.langs == ["aa", "bb", "cc"]
    twice = spark.createDataFrame(own + own[:5], "doc_id long, text string, lang string")
    again = language_codes.predict(twice, model).collect()
    plain = {i: language_codes.LanguageModel.predict(model, [t])[0] for i, t, _ in own}
    assert len(again) == len(own) + 5 and all((r.lang_pred, round(r.score, 6)) == (plain[r.doc_id][0], round(plain[r.doc_id][1], 6)) for r in again)
    assert language_codes.language_digest(docs).count() == docs.count()
    assert language_codes.language_digest(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 7, 12, 40])
def test_codewords_differ(n):
    code = language_codes.codewords(n)
    assert len({tuple(c) for c in code}) == n


def test_secret_scan(spark, docs, empty):
    forest = secret_scan.train(secret_scan.labelled_findings(spark, 2000))
    secret, commit = hashlib.sha1(b"s").hexdigest(), hashlib.sha1(b"c").hexdigest()
    own = spark.createDataFrame([(1, f'a token = "{secret}" end', 9), (2, f"fix commit {commit} now", 9), (3, None, 9), (4, "", 9)], "doc_id long, text string, n_chars long")
    found = {r.doc_id: r for r in secret_scan.findings_digest(own, forest).collect()}
    assert found[1].is_secret and not found[2].is_secret and found[1].start == 11 and found[1].length == 40
    clean = {r.doc_id: r for r in secret_scan.redacted(own, forest).collect()}
    assert clean[1].text == 'a token = "<SECRET>" end' and clean[1].n_chars == len(clean[1].text)
    assert clean[2].text == f"fix commit {commit} now" and clean[3].text is None and clean[4].text == ""
    assert secret_scan.redacted(docs, forest).columns == docs.columns
    assert secret_scan.findings_digest(empty, forest).count() == 0


def test_secret_scan_of_many_candidates(spark):
    """Starts, contexts and masks against a plain version, on a text with thousands of candidates; its time is in proportion."""
    import time

    import regex as re  # like Java's, it looks behind by a varying length

    forest = secret_scan.Forest("CASE WHEN x.digits > 0.5D THEN 1.0D ELSE 0.0D END")
    rng = random.Random(9)
    texts = ["", "no candidates here", hashlib.sha1(b"0").hexdigest()]
    for n in (3, 255, 256, 257, 6000):
        texts.append("é ".join(rng.choice(["", "x ", "\n"]) + hashlib.sha1(str(rng.random()).encode()).hexdigest()[: rng.choice([24, 40])] for _ in range(n)))
    frame = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[3]), (3, texts[3]), (90, None)], "doc_id long, text string")
    began = time.time()
    got = secret_scan.findings_digest(frame, forest).collect()
    assert time.time() - began < 60
    clean = {(r.doc_id, r.text) for r in secret_scan.redacted(frame, forest).collect()}
    pattern, want, masked = re.compile(secret_scan.CandidateRule().pattern), [], set()
    for i, t in list(enumerate(texts)) + [(None, texts[3]), (3, texts[3])]:
        out = t
        for m in reversed(list(pattern.finditer(t))):
            c = m.group()
            secret = sum(x.isdigit() for x in c) / len(c) > 0.5
            want.append((i, m.start(), len(c), secret, hashlib.sha256(c.encode()).hexdigest()))
            out = out[: m.start()] + "<SECRET>" + out[m.end() :] if secret else out
        masked.add((i, out))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.start, r.length, r.is_secret, r.sha256) for r in got], key=key) == sorted(want, key=key)
    assert clean == masked | {(90, None)}


def test_forest_on_findings_held_out(spark):
    forest = secret_scan.train(secret_scan.labelled_findings(spark, 6000))
    held = secret_scan.labelled_findings(spark, 3000, first=1_000_000)
    x = held.select("label", secret_scan.features(F.col("left"), F.col("candidate"), F.col("right")).alias("x"))
    r = x.select("label", (F.expr(forest.expression) >= forest.threshold).cast("int").alias("said")).groupBy("label", "said").count().collect()
    n = {(int(v.label), v.said): v["count"] for v in r}
    assert n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) >= 0.95 and n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.9


def test_written_forest_is_sparks_own(spark):
    model = secret_scan.fit(secret_scan.labelled_findings(spark, 2000))
    held = secret_scan.labelled_findings(spark, 500, first=2_000_000)
    own = model.transform(secret_scan.assembled(held)).select("features", "probability").collect()
    x = held.select(secret_scan.features(F.col("left"), F.col("candidate"), F.col("right")).alias("x"))
    got = {tuple(r.x): r.p for r in x.select("x", F.expr(secret_scan.written(model).expression).alias("p")).collect()}
    assert all(abs(got[tuple(r.features.toArray().tolist())] - r.probability[1]) < 1e-9 for r in own)


def test_secrets_of_lines_that_the_generator_did_not_make(spark):
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    h = lambda x: hashlib.sha1(x.encode()).hexdigest()
    said = {}
    for name, secret in (("secret", True), ("token", True), ("AUTH_TOKEN", True), ("api_key", True), ("commit", False), ("sha1", False), ("checksum", False), ("etag", False)):
        for before in ("", "word words ", "a token and a commit "):
            for space, quote in (("=", ""), (" = ", '"'), (": ", "")):
                said[f"{before}{name}{space}{quote}{h(name + space)}{quote}"] = secret
    said |= {f"AWS_SECRET_ACCESS_KEY={'aB3dE5gH7jK9mN1pQ3rS5tU7vW9xY1zA3bC5dE7fG'}": True, 'password = "Tr0ub4dor99"': True, "DB_PASSWORD=h4Xk29qLw": True, "pwd=Zx9#kLm2Qp": True}
    said |= {"password: example123": False, "key: section12": False, f"fix commit {h('c')} now": False, f"token revision {h('d')}": False, "sha256:" + hashlib.sha256(b"q").hexdigest(): False}
    lines = list(said)
    found = secret_scan.findings_digest(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), forest).collect()
    assert {lines[r.doc_id]: r.is_secret for r in found} == said and len(found) == len(said)


def test_redaction_survives_any_projection(spark):
    import itertools

    frame = spark.createDataFrame([(1, "token = " + hashlib.sha1(b"s").hexdigest(), 48, "x", "y", "z")], "doc_id long, text string, n_chars long, parts string, t string, `a.b` string")
    clean = secret_scan.redacted(frame, secret_scan.Forest("1.0D"))
    whole = clean.first().asDict()
    assert whole["text"] == "token = <SECRET>" and whole["n_chars"] == 16
    for pair in itertools.chain(itertools.combinations(clean.columns, 1), itertools.combinations(clean.columns, 2)):
        assert clean.select(*[f"`{c}`" for c in pair]).first().asDict() == {c: whole[c] for c in pair}
    assert clean.filter("n_chars > 20").count() == 0


def test_pieces(spark, docs, empty):
    import sentencepiece

    path = tokenizers_.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.piece_digest(docs, path, with_ids=True).join(docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
        want = lib.encode(r.text or "")
        assert r.ids == want and r.spans_ok and r.n_tokens == len(want)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(want).encode()).hexdigest()
    assert pieces.piece_digest(empty, path).count() == 0
    odd = spark.createDataFrame([(k, t) for k, t in enumerate([" a", "a ", "a  b", "▁x ▁", "\0 a", "  ", "é😀 z", None])], "doc_id long, text string")
    both = pieces.encode_pieces(odd, path)
    for r in both.join(odd, "doc_id").collect():
        data = (r.text or "").encode()
        assert r.ids == lib.encode(r.text or "") and (r.ends[-1] if r.ends else 0) == len(data)
        assert all(a <= b for a, b in zip(r.starts, r.ends, strict=True))
    back = {r.doc_id: r.text for r in pieces.decode_pieces(both, path).collect()}
    assert back[1] == "a " and back[7] == ""


def double_array(keys: dict[bytes, int]) -> bytes:
    """A tiny double array with room for each node's children in a block of its own."""
    import struct

    units, blocks = {0: 0}, 0
    nodes = {b"": 0}
    for key in sorted({k[:j] for k in keys for j in range(len(k) + 1)}, key=len):
        at = nodes[key]
        below = sorted({k[len(key)] for k in keys if k.startswith(key) and len(k) > len(key)})
        blocks += 1
        base = blocks << 8
        units[at] = units.get(at, 0) | (at ^ base) << 10 | (0x100 if key in keys else 0)
        if key in keys:
            units[base] = 0x80000000 | keys[key]
        for c in below:
            units[base ^ c] = c
            nodes[key + bytes([c])] = base ^ c
    n = -(-(max(units) + 1) // 256) * 256
    return struct.pack(f"<{n}I", *[units.get(k, 0) for k in range(n)])


def compiled(rules: dict[str, str]) -> bytes:
    import struct

    values, keys = b"", {}
    for key, value in rules.items():
        keys[key.encode()] = len(values)
        values += value.encode() + b"\0"
    trie = double_array(keys)
    return struct.pack("<I", len(trie)) + trie + values


def test_compiled_map_takes_the_longest_prefix():
    cmap = pieces.CharsMap(compiled({"a": "X", "abc": "Y", "b": "Z"}))
    assert [cmap.longest(t, 0) for t in (b"abc", b"abd", b"b", b"q")] == [(3, 2), (1, 0), (1, 4), (0, 0)]
    assert [cmap.replacement(k) for k in (0, 2, 4)] == [b"X", b"Y", b"Z"]


@pytest.mark.parametrize("squeeze", [False, True])
def test_spans_through_a_map_are_those_of_the_library(tmp_path, squeeze):
    """The public model with a map of its own put in: ligatures, wide letters, longer and shorter replacements, and one that vanishes."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(tokenizers_.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.precompiled_charsmap = compiled({"ﬁ": "fi", "Ａ": "A", "①": "1", "\u3000": " ", "Q": "q", "Qu": "kw", "½": "1/2", "é": "é"})
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    path = str(tmp_path / "own.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    model, lib = pieces.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    bits = ["ﬁ", "Ａ", "①", "\u3000", "Qu", "Q", "½", "é", "the", "word", " ", "  ", "日", "😀", "x"]
    for _ in range(200):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        ids, starts, ends = model.encode(text)
        want = lib.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in want.pieces]
        if all(not lib.is_byte(p.id) for p in want.pieces):
            chars = lambda at: len(text.encode()[:at].decode(errors="ignore"))
            assert [(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] == [(p.begin, p.end) for p in want.pieces], text


def test_alignment_of_a_map_without_keys_is_that_of_the_walk(rows):
    model = pieces.Model(tokenizers_.path("piece_bpe_32k.model"))
    assert model.simple and not model.map.units
    for t in [t or "" for _, t in rows if len(t or "") < 5000] + [" a", "a ", "a  b", "  ", "é😀 z", "\0 a", "a\tb\nc"]:
        assert model.places(t).tolist() == model.normalised(t)[1].tolist()
        for way, want in zip(model.spans(t, model.entries(t)), model.whole(t), strict=True):
            assert way.tolist() == want.tolist()


def test_cap_filters_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    v = np.concatenate([base, base[:20] + 0.05 * rng.standard_normal((20, 16)), base[:1].repeat(5, 0)]).astype(np.float32)
    own = [(k, x.tolist(), 1) for k, x in enumerate(v)] + [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, [1.0, 2.0], 1)]
    own += [(7, None, 1), (7, None, 1), (5, v[5].tolist(), 1), (None, v[0].tolist(), 1)]  # a good and null vectors of one vec_id, a repeated row
    frame = spark.createDataFrame(own, "vec_id long, embedding array<float>, copies int")
    every = cap_filters.embedding_digest(frame, cap_filters.CapFilters(chunk=8)).collect()
    assert len(every) == len(own) and sorted(r.n_links > 0 for r in every if r.vec_id == 7) in ([False] * 3, [False, False, True])
    assert [r.n_links for r in every if r.vec_id is None] == [0]
    got = {r.vec_id: r for r in every if r.vec_id not in (5, 7, None)} | {r.vec_id: r for r in sorted((r for r in every if r.vec_id in (5, 7)), key=lambda r: r.n_links)}
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    close = (x @ x.T >= 0.95).astype(int)
    np.fill_diagonal(close, 0)
    close = close + np.outer(np.ones(len(v), int), np.arange(len(v)) == 5) * close  # the repeated row is another vector
    close[5, 5] = 1
    found = sum(got[k].n_links for k in range(len(v)))
    assert 0.98 * close.sum() <= found <= close.sum()
    assert all(got[k].n_links <= close[k].sum() for k in range(len(v)))
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in (200, 201, 202, 203, 204))
    assert got[60].component_id == 0 and cap_filters.embedding_digest(frame.filter("vec_id < 0")).count() == 0


def test_list_decoding_finds_all_filters():
    rng = np.random.default_rng(3)
    options = cap_filters.CapFilters()
    cuts, codes, t = cap_filters.code(12, 2000, options)
    x = rng.standard_normal((30, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = cap_filters.decode(x, cuts, codes, t)
    size = len(codes[0])
    for k in range(30):
        s = [x[k, cut] @ c.T for cut, c in zip(cuts, codes, strict=True)]
        want = [(a * size + b) * size + c for a in range(size) for b in range(size) for c in range(size) if s[0][a] + s[1][b] + s[2][c] > t]
        assert got[k].tolist() == want


@pytest.mark.parametrize("dims, n", [(1, 1000), (2, 10_000), (6, 10_000), (64, 10_000), (64, 1_000_000)])
def test_filters_of_all_vectors_and_their_recall(dims, n):
    """Pairs of distinct vectors just above the similarity, by production parameters; other pairs than those the codes are made by."""
    options = cap_filters.CapFilters()
    codes, met = cap_filters.covering(dims, n, options)
    x, y = cap_filters.pairs_at(dims, 3000, 0.952, 77)
    a, b = (cap_filters.filter_lists(v, codes, options.each) for v in (x, y))
    assert met >= options.recall and min(map(len, a)) >= min(options.load, len(codes)) and all((np.diff(f) > 0).all() for f in a)
    assert np.mean([np.isin(p, q).any() for p, q in zip(a, b, strict=True)]) >= 0.998


def test_vectors_along_one_axis_have_few_filters():
    options = cap_filters.CapFilters()
    lists = cap_filters.filter_lists(np.eye(64), cap_filters.covering(64, 50_000, options)[0], options.each)
    assert max(map(len, lists)) <= 2 * options.load


def test_cap_filters_link_planted_pairs(spark):
    x, y = cap_filters.pairs_at(64, 3000, 0.952, 78)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in cap_filters.embedding_digest(frame).collect()}
    assert len(got) == 6000 and sum(got[k].n_links == got[k + 3000].n_links == 1 and got[k + 3000].component_id == k for k in range(3000)) >= 2990


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_ngram_join(rows, docs, empty, words, percent):
    sets = {i: brute.shingles(t, words) for i, t in rows}
    want = brute.components(sorted(sets), lambda a, b: brute.similar(sets[a], sets[b], percent))
    rule = ngram_join.JoinRule(words=words, percent=percent, group_keys=500)
    got = ngram_join.join_digest(docs, rule).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    assert ngram_join.join_digest(empty, rule).count() == 0
    kept = ngram_join.keep_first(docs, rule)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i} | {None}


def test_keep_first_keeps_all_rows_of_a_kept_doc_id(spark):
    body = " ".join(f"w{k}" for k in range(40))
    own = spark.createDataFrame([(1, body), (1, body), (2, body), (2, body)], "doc_id long, text string")
    assert [r.doc_id for r in ngram_join.keep_first(own).collect()] == [1, 1]


@pytest.mark.parametrize("seed", range(5))
def test_prefix_tree_finds_every_link(seed):
    rng = random.Random(seed)
    base = [rng.sample(range(200), 60) for _ in range(4)]
    sets = [sorted(set(rng.choice(base)[: rng.randint(40, 60)]) ^ set(rng.sample(range(200), rng.randint(0, 4)))) for _ in range(60)]
    sets += [sets[k] for k in range(12)]
    held = [np.asarray(s, np.uint64) for s in sets]
    sizes = [len(s) + rng.randint(0, 6) for s in sets]  # with keys that no other set has
    sizes[60:66] = [sizes[k] for k in range(6)]
    sizes[66:] = [len(s) + 12 for s in sets[66:]]
    for k in range(6, 12):
        sizes[k] = len(sets[k]) + 12  # equal keys and sizes, yet unlike
    full = [frozenset(s) | {(k, j) for j in range(n - len(s))} for k, (s, n) in enumerate(zip(sets, sizes, strict=True))]
    linked = lambda a, b: brute.similar(full[a], full[b], 85)
    ids = list(range(len(sets)))
    links = set(ngram_join.links_among(ids, held, sizes, 85))
    assert all(linked(a, b) for a, b in links)
    assert brute.components(ids, lambda a, b: (a, b) in links or (b, a) in links) == brute.components(ids, linked)
    across = set(ngram_join.links_among(ids, held, sizes, 85, 30))
    far = lambda a, b: (a < 30) != (b < 30) and linked(a, b)
    own = lambda a, b: held[a].tolist() == held[b].tolist() and sizes[a] == sizes[b] and linked(a, b)
    got = brute.components(ids, lambda a, b: (a, b) in across or (b, a) in across or own(a, b) and (a < 30) == (b < 30))
    assert got == brute.components(ids, lambda a, b: far(a, b) or own(a, b) and (a < 30) == (b < 30))


def test_shingles_of_joined_texts():
    rng = random.Random(8)
    bits = ["aB", "Ab", "é", "É", "x", " ", "\n", "\t\v", "\u00a0", "日本 ", "q" * 3000 + " "]
    texts = ["", " ", "one", "a b", "A B"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["w" * 300_000, " ".join("v%d" % k for k in range(90_000))]
    data = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, data)])
    for n in (1, 3, 5):
        shingler, known = ngram_join.Shingler(n), {}
        for text, d, keys in zip(texts, data, shingler.sets(b"".join(data), starts), strict=True):
            want = brute.shingles(text, n)
            assert len(keys) == len(want) and (np.diff(keys.astype(object)) > 0).all() and (keys == shingler.keys(d)).all()
            if len(want) < 200:
                assert known.setdefault(frozenset(keys.tolist()), want) == want


@pytest.mark.parametrize("group_keys", [60, 400, 150_000])
def test_large_centres_lose_no_link(spark, group_keys):
    """A group of near copies, most of them linked in chains, some only by a document of another part, and blocks of unlike sizes."""
    rng = random.Random(group_keys)
    words = [f"w{k}" for k in range(90)]
    rows = []
    for k in range(120):
        own = words[: rng.randint(45, 90)]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(own)))
    rows += [(7, " ".join(f"y{k}" for k in range(30))), (200, " ".join(f"Y{k} " for k in range(30))), (7, rows[3][1])]
    sets = [brute.shingles(t, 3) for _, t in rows]
    same = lambda a, b: rows[a][0] == rows[b][0] or brute.similar(sets[a], sets[b], 80)
    comp = brute.components(list(range(len(rows))), same)
    least = {}
    for k, c in comp.items():
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    rule = ngram_join.JoinRule(words=3, percent=80, group_keys=group_keys, hubs=2)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_digest(frame, rule).collect()}
    assert got == {(i, len(sets[k]), least[comp[k]]) for k, (i, _) in enumerate(rows)}


def test_components(spark):
    rng = random.Random(6)
    pairs = [(k, k + 1) for k in range(200, 260)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(500, k) for k in range(501, 600)]
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    both = set(pairs) | {(b, a) for a, b in pairs}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long"), shared_dir(spark)).collect()}
    assert got == brute.components(nodes, lambda a, b: (a, b) in both)
