"""Operators against plain versions, on the smallest tables and on odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from replicalens.llm import classifier, exact, kneser_ney, mixing, packing, queries, repetition, secret_scan, sharding, simhash, substring

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, th int, fp double, label string, size string, __x int"
TOKENS = public_tokenizers.path("word_bpe_49k.json")


def _odd_rows():
    rng = random.Random(3)
    vocabulary = ["a", "The", "the,", "É", "x" * 40, "naïve", "#", "|", "idiot", "0f" * 13, "token=abcdef123", "AKIA" + "A1" * 9]
    passage = " ".join(rng.choice(vocabulary) + str(i % 7) for i in range(70))
    texts = [None, "", " \t\n", "one", "two words", passage, "pre " + passage, passage + " post\n" + passage, "w " * 300, "w " * 300,
             "a b c d e f g h\n" * 12, "password: 'hunter22' secret=xy token = \"abcdefgh", "deadbeef" * 4 + " é " + "deadbeef" * 4,
             " ".join(rng.choice(vocabulary) for _ in range(20_000))]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts + texts[:12])]
    return rows + [rows[5]]  # a repeated row


ODD = _odd_rows()


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{i % 3}" if i % 5 else None, None, "id", 1, 0.5, "l", "z", 3) for i, (d, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).repartition(3).persist()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_simhash(spark, docs, rows, odd):
    for df, plain in ((docs, rows), (odd, ODD), (frame(spark, [(None, "a b c"), (4, "a b c"), (None, None)]), [(None, "a b c"), (4, "a b c"), (None, None)])):
        found = simhash.near_duplicates(df).select("doc_id", simhash.hex_digits(F.col("fp")), "component_id")
        assert got(found) == brute.simhash(plain)


@pytest.mark.parametrize("radius,segments", [(2, 2), (7, 4)])
def test_crowded_segments_lose_no_link(spark, radius, segments):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for c in centres for _ in range(60)})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    found = simhash.components(simhash.links(df, radius, segments, hot=3, block=5)).collect()
    label = {r["node"]: r["label"] for r in found}
    groups = {}
    for f in fps:
        near = [g for g in groups if any((f ^ x).bit_count() <= radius for x in groups[g])]
        merged = {f}.union(*(groups.pop(g) for g in near))
        groups[f] = merged
    signed = lambda f: int(np.uint64(f).astype(np.int64))
    expected = {frozenset(map(signed, g)) for g in groups.values()}
    by_label = {}
    for f in map(signed, fps):
        by_label.setdefault(label.get(f, f), set()).add(f)
    assert set(map(frozenset, by_label.values())) == expected


def test_one_per_group(spark, odd):
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    parts = {c for _, _, c in brute.simhash(ODD)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(parts)


def test_one_per_group_of_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words[i:i + 100]) for i in range(0, 600, 100)]
    found = simhash.one_per_group(frame(spark, list(zip([None, None, None, 7, 7, 9], texts)))).select("doc_id", "text")
    assert got(found) == sorted(zip([None, None, None, 7, 7, 9], texts), key=str)


@pytest.mark.parametrize("texts", [[None, "", " \n"], [None]])
def test_mixing_without_words(spark, texts):
    found = mixing.mix(frame(spark, list(enumerate(texts)))).select("doc_id", "target", "copies")
    assert got(found) == [(i, 0.0, 0) for i in range(len(texts))]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutation(n):
    out = sharding.permute(np.arange(n), n, 7)
    assert sorted(out) == list(range(n))
    assert (sharding.permute(out, n, 7, inverse=True) == np.arange(n)).all()


def test_sharding(odd):
    found = sharding.shard_rows(odd, 40).collect()
    again = sharding.shard_rows(odd.repartition(7), 40)
    assert got(again.select("doc_id", "shard", "slot")) == sorted(((r["doc_id"], r["shard"], r["slot"]) for r in found), key=str)
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(s, [])) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    expected = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in ODD), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=str) == expected


@pytest.mark.parametrize("hot", [1, 5_000])
def test_substring(docs, rows, odd, hot):
    for df, plain in ((docs, rows), (odd, ODD)):
        kept = substring.remove_repeats(df, hot=hot, group=50)
        assert got(kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))) == sorted(brute.without_repeats(plain), key=str)


def test_packing(docs, rows, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENS)
    for df, plain in ((docs, rows), (odd.dropDuplicates(["doc_id"]), None)):
        plain = plain or [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        found = packing.pack(df, TOKENS).collect()
        by_doc, by_sequence = {}, {}
        for r in found:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_sequence.setdefault(r["sequence_id"], []).append(r)
        for d, t in plain:
            ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at:at + r["length"]].tobytes()))
                at += r["length"]
            assert at == len(ids)
        for pieces in by_sequence.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 4096
        assert sorted(by_sequence) == list(range(len(by_sequence)))
        total = sum(r["length"] for r in found)
        assert len(by_sequence) <= 1 + 1.08 * total / 4096
        classes = {}
        for r in found:
            classes.setdefault((r["klass"], r["sequence_id"]), []).append(r)


def test_token_runs():
    rng = random.Random(1)
    parts = list("aAbİßΣς'’sté́̀ \n\t \x1c\x85가각１٣½<|>!?.,‍") + ["<|endoftext|>", "'ll"]
    ids = packing.word_ids(TOKENS)
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert ids.of(t) == np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), ascii(t)


def test_cuts_waste_little():
    for n in range(1, 9000, 7):
        pieces = packing.cuts(n, 4096, 32, 0.95)
        assert sum(a for a, _ in pieces) == n
        assert all(k == 32 or (k * a >= 0.95 * 4096 or a == 4096 // k) and k * a <= 4096 for a, k in pieces)


def test_repetition(rows, docs, odd):
    for df, plain in ((docs, rows), (odd, [r for r in ODD if len(r[1] or "") < 50_000])):
        found = repetition.repetition_counts(df.filter("length(coalesce(text, '')) < 50000"))
        short = [r for r in plain if len(r[1] or "") < 50_000]
        columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
        assert got(found.select("doc_id", *columns)) == sorted(((d, *brute.repetition(t)) for d, t in short), key=str)


def plain_maximal_repeats(w, least):
    return {tuple(w[i:i + n]) for i in range(len(w)) for j in range(i) if i == 0 or j == 0 or w[i - 1] != w[j - 1]
            for n in [next((k for k in range(len(w) - i) if w[i + k] != w[j + k]), len(w) - i)] if n >= least}


@pytest.mark.parametrize("seed", range(8))
def test_maximal_repeats(seed):
    rng = random.Random(seed)
    docs = [[rng.choice([b"a", b"b", b"c"][:rng.randint(1, 3)]) for _ in range(rng.randint(0, 60))] for _ in range(12)]
    twenty = [b"w%d" % i for i in range(20)]
    docs.append([*twenty, b"x", *twenty, b"y", *twenty[:10], b"z"])
    for least in (1, 3, 8):
        assert repetition.repetition(docs, least)[:, 1].tolist() == [len(plain_maximal_repeats(d, least)) for d in docs]
    assert repetition.repetition(docs, 8)[-1, 1] == 2


def clashing(spark):
    """Columns named like those that operators make on their way."""
    rows = [(i, f"some words that stand in text number {i} " * 3, "en", f"s{i % 2}", i, "id", 1.5, "e", "h", i, "k", "g", "r", "w") for i in range(12)]
    return spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string, __id long, id string, fp double, __e string, __h string, row long, "
                                                  "__text string, `group` string, digest string, words string")


def test_clashing_columns(spark):
    docs = clashing(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    for out in (exact.drop_copies(docs), simhash.one_per_group(docs), mixing.repeated(docs), classifier.assess(docs, labels).drop("assessment")):
        assert out.columns == docs.columns
        found = {tuple(r) for r in out.collect()}
        assert found and found <= {tuple(r) for r in docs.collect()}
    again = classifier.assess(docs.withColumn("assessment", F.lit(1)), labels)
    assert again.columns == [*docs.columns, "assessment"] and again.filter("assessment.kept is null").count() == 0


def test_repetition_verdict(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    half = " ".join(f"w{i}" for i in range(100))
    df = frame(spark, [(1, clean), (2, clean[:100]), (3, "a b c d " * 50), (4, f"{half} x {half}"), (5, clean + " " + " ".join(f"w{i}" for i in range(60)))])
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in repetition.repetition_rules(df).collect()}
    assert found == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (False, False)}


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rest = labels.filter("doc_id % 4 = 1").withColumnRenamed("doc_id", "other")
    found = classifier.assess(docs, labels.filter("doc_id % 4 <> 1")).join(rest, F.col("doc_id") == F.col("other"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    kept = F.col("assessment.kept")
    n, wrong_drop, wrong_keep = found.agg(F.count_if(~bad), F.count_if(~bad & ~kept), F.count_if(bad & kept)).first()
    assert wrong_drop <= 0.02 * n and wrong_keep <= 0.25 * (found.count() - n)


def test_classifier_odd_rows(spark, odd):
    labels = spark.createDataFrame([(d, None if d % 5 == 0 else d % 2, None if d % 3 else 1) for d, _ in ODD] + [(None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert classifier.assess(odd, labels).count() == len(ODD)
    none = classifier.assess(odd, labels.limit(0))
    assert none.columns == [*odd.columns, "assessment"] and none.filter("assessment.kept").count() == len(ODD)


def test_site_priors_shrink(spark):
    sites = spark.createDataFrame([("big", "big/a", 1000, 500), ("big", "big/b", 0, 0), ("small", "small/a", 1, 1), ("other", "other/a", 1000, 100), ("none", "none/a", 0, 0)], "host string, path string, n long, poor long")
    prior = {r["path"]: r["poor_prior"] for r in classifier.site_priors(sites, "poor").collect()}
    assert abs(prior["big/a"] - 0.5) < 0.02 and abs(prior["other/a"] - 0.1) < 0.02
    assert abs(prior["big/b"] - 0.5) < 0.05 and 0.25 < prior["small/a"] < 0.9
    assert abs(prior["none/a"] - 601 / 2001) < 0.01


def test_mixing_targets(spark, odd):
    found = mixing.mix(odd).collect()
    sources = {}
    for r in found:
        s = sources.setdefault(r["source"], [r["source_size"], r["target"], 0, 0, 0])
        s[2] += r["size"]
        s[3] += r["taken"]
        s[4] = max(s[4], r["size"])
        assert r["taken"] <= 2 * r["size"]
    assert all(size == total and abs(taken - target) <= longest / 2 + 1e-6 for size, target, total, taken, longest in sources.values())
    assert abs(sum(s[1] for s in sources.values()) - 1.5 * sum(s[0] for s in sources.values())) < 1e-6 * sum(s[0] for s in sources.values())
    assert got(mixing.mix(odd.repartition(5)).select("doc_id", "source", "size", "copies")) == sorted(((r["doc_id"], r["source"], r["size"], r["copies"]) for r in found), key=str)
    out = mixing.repeated(odd)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in found)


def test_water_fill(spark):
    sources = spark.createDataFrame([("a", 10, 3.0), ("b", 1000, 1.0), ("c", 100, 2.0), ("d", 0, 1.0)], "source string, source_size long, weight double")
    target = {r["source"]: r["target"] for r in mixing.water_fill(sources, 1500.0, 2.0).collect()}
    assert target == {"a": 20.0, "b": 1280.0, "c": 200.0, "d": 0.0}
    assert {r["target"] for r in mixing.water_fill(sources, 1e9, 2.0).collect()} == {20.0, 2000.0, 200.0, 0.0}


def test_exact(odd):
    groups = {}
    for d, t in ODD:
        groups.setdefault(t or "", []).append(d)
    found = exact.exact_groups(odd)
    expected = [(d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""])) for d, t in ODD]
    assert got(found.select("doc_id", "keep_id", "group_size", "kept")) == sorted(expected, key=str)
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((max(v), t) for t, v in groups.items())


def test_kneser_ney(docs, rows, odd):
    for df, plain in ((docs, rows), (odd, ODD)):
        model = brute.KneserNey(plain)
        found = {r["doc_id"]: r for r in kneser_ney.score(df, kneser_ney.train(df, pairs_per_shard=5_000)).collect()}
        texts = dict(plain)
        for d in sorted(texts)[:60]:
            tokens, known, base, score = model.score(texts[d])
            r = found[d]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, model.n)
            assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)
    some = brute.KneserNey([(1, "a b a c a b"), (3, "b a c c"), (6, "a b c d")])
    assert sum(some.p("a", w) for w in some.words) + some.lower("?") * sum(some.d1[min(c, 3) - 1] for c in some.after["a"]) / sum(some.after["a"]) == pytest.approx(1.0)


def test_secrets(docs, rows, odd):
    for df, plain in ((docs, rows), (odd, ODD)):
        found = secret_scan.scan_versions(df, rules=secret_scan.BASE)
        out = found.select("path", *[secret_scan.counted(F.col("findings"), r.kind) for r in secret_scan.BASE],
                           F.sha2(secret_scan.spelled(F.col("findings")), 256), secret_scan.spelled(F.col("findings")))
        assert got(out) == sorted(((d, *brute.secrets(t)) for d, t in plain), key=str)


def test_long_logins(spark):
    text = f"see https://{'u' * 150}:{'p' * 5000}@host.example/x"
    found = secret_scan.scan_versions(frame(spark, [(1, text), (2, "https://user:word host")])).select("path", "findings")
    spans = {r["path"]: [(f["kind"], f["start"], f["end"]) for f in r["findings"] if f["kind"] == "login"] for r in found.collect()}
    assert spans == {1: [("login", 4, len(text) - 2)], 2: []}


def test_ledger_scans_only_what_it_has_not_seen(spark, odd, tmp_path):
    path, (first, *_, last) = str(tmp_path / "ledger"), secret_scan.RULES
    secret_scan.scan_versions(odd.limit(20), path, [first]).count()
    before = spark.read.parquet(path).count()
    secret_scan.scan_versions(odd.limit(20), path, [first]).count()
    assert spark.read.parquet(path).count() == before
    full = secret_scan.scan_versions(odd, path, secret_scan.RULES)
    assert got(full.select("path", secret_scan.spelled(F.col("findings")))) == got(secret_scan.scan_versions(odd).select("path", secret_scan.spelled(F.col("findings"))))
    ledger = spark.read.parquet(path)
    assert ledger.select("blob", F.explode("rules").alias("r")).groupBy("blob", "r").count().filter("count > 1").count() == 0
    raised = secret_scan.Rule(first.kind, "password", version=2)
    found = secret_scan.scan_versions(odd, path, [raised])
    assert found.select(F.explode("findings").alias("f")).filter("f.end - f.start <> 8").count() == 0


def test_empty_tables(spark, docs):
    empty, labels = docs.limit(0), spark.read.parquet(f"{SF}/labels.parquet")
    for df in (simhash.near_duplicates(empty), sharding.shard_rows(empty, 40), substring.remove_repeats(empty), packing.pack(empty, TOKENS), repetition.repetition_rules(empty),
               classifier.assess(empty, labels), mixing.mix(empty), mixing.repeated(empty), exact.exact_groups(empty), exact.drop_copies(empty),
               kneser_ney.score(docs, kneser_ney.train(empty)).filter("score > 0"), secret_scan.scan_versions(empty)):
        assert df.count() == 0


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} >= {f"op{n}" for n in range(1, 14)}
