import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coppice.llm import coder, decontaminate, fingerprints, jaccard_join, language, licenses, line_dedup, mixing, sharding, token_files, url_filter
from coppice.operators import graph

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, a column whose name clashes."""
    long = " ".join(f"w{i}" for i in range(3000))
    texts = [None, "", "  \n ", "one", "one two", long, long, "a b c d e f g", "a b c d e f g"]
    return make(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, 7]).union(make(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("token", F.lit(1)).withColumn("n", F.lit(2)).withColumn("bucket", F.lit(3))


def test_coder_round_trip_and_checksum():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000, 9000):
        for ids in (rng.integers(0, 60000, n), np.zeros(n), np.minimum(rng.zipf(1.3, n), 50000)):
            ids = ids.astype(np.uint32)
            header, payload = coder.encode(ids, 16)
            assert (coder.decode(n, header, payload, 16) == ids).all()
    header, payload = coder.encode(np.arange(9000, dtype=np.uint32), 16)
    broken = bytearray(payload)
    broken[100] ^= 1
    with pytest.raises(ValueError):
        coder.decode(9000, header, bytes(broken), 16)


def test_encoder_equals_whole_texts():
    """Texts of white space of all kinds, words, marks and nothing, cut and encoded piece by piece, as the tokenizer encodes them whole."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    parts = [" ", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "\x1f", "\x85", "a", "it's", "Wört", "12", "...", "'", "的", "🙂", ""]
    rng = np.random.default_rng(3)
    texts = [None, "", " ", "  ", *("".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000))]
    ids, n = token_files.Encoder(path)(pa.array(texts), 7)
    expected = [[*tokenizer.encode(x or "", add_special_tokens=False).ids, 7] for x in texts]
    assert n.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    assert sum(x.num_rows for x in token_files.slices(batch)) == len(texts)


def test_encoder_merges_each_word_once(monkeypatch):
    """Words are merged once, whatever marks and line ends stand beside them; the whole library has to encode other pieces only."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encode = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    merged, whole = [], []
    merge, by_library = encode.merge, encode.whole
    monkeypatch.setattr(encode, "merge", lambda x: merged.append(x) or merge(x))
    monkeypatch.setattr(encode, "whole", lambda x: whole.extend(x) or by_library(x))
    texts = ["some wörds, some wörds.\nsome wörds! it's 12, 12.", "some wörds; 的 \u0e01 <|endoftext|>, wörds."]
    ids, n = encode(pa.array(texts), 7)
    assert sorted(whole) == [" <|endoftext|>,", " \u0e01"]
    assert len(merged) == len(set(merged)) and sum("rds" in x for x in merged) == 1
    expected = [[*encode.tokenizer.encode(x, add_special_tokens=False).ids, 7] for x in texts]
    assert n.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]


def test_coder_bytes_are_those_of_the_format():
    """Checksums of files that the coder wrote when it went step by step throughout."""
    rng = np.random.default_rng(5)
    for n, bits, expected in ((1, 16, (3656189986, 2562572103)), (9000, 16, (2393186925, 389845689)), (20001, 24, (1787405930, 1826339288))):
        ids = np.minimum(rng.zipf(1.3, n), 50000).astype(np.uint32)
        header, payload = coder.encode(ids, bits)
        assert (zlib.crc32(header), zlib.crc32(payload)) == expected


def test_token_files(spark, odd, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    token_files.write_tokens(odd, f"file://{tmp_path}/t", path, 0, partitions=2)
    rows = token_files.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    tokenizer, start = Tokenizer.from_file(path), 0
    assert [r["doc_id"] for r in rows] == [None, 0, 1, 2, 3, 4, 5, 6, 7, 7]
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in rows:
        ids = [*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert r["ids"] == ids and r["start"] == start and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4"))
        start += len(ids)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (7, 9), (9, 8)], "a long, b long")
    assert {(r["node"], r["component"]) for r in graph.components(edges, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 7), (9, 7)}
    assert graph.components(edges.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, k, percent):
    rng = random.Random(k)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(2, 120))] for _ in range(30)]
    texts = []
    for words in base:
        for _ in range(rng.randrange(1, 6)):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
    texts += ["", "   ", "one two", "One  Two", None]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(make(spark, texts), k=k, percent=percent).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_jaccard_links_equal_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for g in range(4):
        words = [f"g{g}w{i}" for i in range(60)]
        for _ in range(12):
            copy = list(words)
            copy[rng.randrange(2)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += texts[:3] + ["", None]
    sets = [frozenset(zip(*[(t or "").split()[i:] for i in range(3)], strict=False)) for t in texts]
    links = lambda a: sum(100 * len(a & b) >= 90 * len(a | b) for b in set(sets) - {a, frozenset()}) if a else 0
    got = {r["doc_id"]: r["links"] for r in jaccard_join.jaccard_components(make(spark, texts), k=3, percent=90).collect()}
    assert got == {i: links(a) for i, a in enumerate(sets)} and max(got.values()) > 1


def test_jaccard_odd_rows(spark, odd):
    assert jaccard_join.jaccard_components(odd).count() == odd.count()
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert jaccard_join.keep_one(odd.limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(1)
    words = {"aa": ["bada", "dabo", "abad", "boda"], "bb": ["chirk", "krich", "richk", "irkch"]}
    text = lambda l: " ".join(rng.choice(words[l]) for _ in range(40))
    labelled = spark.createDataFrame([(text(l), l) for l in words for _ in range(20)], "text string, lang string")
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.example.{'aa'}/x", f'<html lang="{l}"><body>{text(l)}</body></html>') for i, l in enumerate(["aa", "bb"] * 10)] + [(100, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["language"] for r in language.identify_pages(pages, labelled).collect()}
    assert len(got) == 21 and all(got[i] == ["aa", "bb"][i % 2] for i in range(20))
    docs = labelled.select(F.monotonically_increasing_id().alias("doc_id"), "text", "lang", F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    assert language.keep_identified(docs).count() == 40


def test_licenses(spark, odd):
    docs = make(spark, ["x\nReleased under the MIT License.\ny", "released under  the mit licence!", "nothing", None, "Licensed under the Apache License, Version 2.0"])
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).where("kind = 'line'").collect()}
    assert got == {(0, "MIT"), (4, "Apache-2.0")}
    assert licenses.scan(odd).count() == 0 and licenses.scan(odd.limit(0)).count() == 0


def test_licenses_within_longer_text(spark):
    gpl = licenses.TEMPLATES["GPL-3.0 header"].split()
    wrapped = "\n".join("# " + " ".join(gpl[i : i + 9]) for i in range(0, len(gpl), 9)) + "\nimport os\nprint(os.name)\n" * 8
    mit = "The code on this page is released under the MIT License."
    twice = "so it is licensed under CC BY-NC 4.0 and then the rest is also licensed under cc by-nc 4.0 as said"
    got = {(r["doc_id"], r["license"], r["at"]): r["dice"] for r in licenses.scan(make(spark, [mit, wrapped, twice, "released under the moon"])).where("kind = 'window'").collect()}
    assert got == {(0, "MIT", 6): 1.0, (1, "GPL-3.0 header", 0): 1.0, (2, "CC-BY-NC-4.0", 3): 1.0, (2, "CC-BY-NC-4.0", 16): 1.0}
    # any window of Dice 0.8 or more overlaps one that is returned
    rng = random.Random(6)
    template = [rng.choice("abc") for _ in range(12)]
    texts = [[rng.choice("abc") for _ in range(20)] + [w for w in template if rng.random() < 0.95] + [rng.choice("abc") for _ in range(20)] for _ in range(60)]
    found = licenses.scan(make(spark, [" ".join(x) for x in texts]), {"T": " ".join(template)}).where("kind = 'window'").collect()
    from collections import Counter

    pairs = lambda w: Counter(zip(w, w[1:], strict=False))
    dice = lambda w: 2 * sum((pairs(w) & pairs(template)).values()) / (len(w) - 1 + len(template) - 1)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r["at"])
        assert r["dice"] == round(dice(texts[r["doc_id"]][r["at"] :][:12]), 9) >= 0.8
    for i, words in enumerate(texts):
        for a in range(len(words) - 11):
            if dice(words[a : a + 12]) >= 0.8:
                assert any(abs(a - at) < 2 * 12 for at in by.get(i, []))
    assert found


def test_fingerprints_estimate_generalised_jaccard(spark, odd):
    rng = random.Random(5)
    # neighbours share half of their words, and every pair has words of its own: the pairs' errors are independent
    docs = make(spark, [" ".join(f"w{30 * i + rng.randrange(60)}" for _ in range(200)) for i in range(60)])
    rows = fingerprints.fingerprint(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    from collections import Counter

    off = []
    for r in rows:
        a, b = Counter(texts[r["doc_id"]].split()), Counter(texts[(r["doc_id"] - 1) % 60].split())
        off.append(r["near_next"] - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(off)) < 0.02
    found = fingerprints.fingerprint(odd).collect()
    assert len(found) == odd.count()
    by = {r["doc_id"]: r["fingerprint"] for r in found}
    assert by[5] == by[6] and by[0] == by[1] == by[2]


def test_line_dedup(spark, odd):
    run = "one two three four five six seven eight nine"
    docs = make(spark, [f"start a\n{run}\nend", f"{run}\nother\nlast", f"x\n{run}\nother\nlast", None])
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    # of row 2's run the first line began in row 0, and with all of its lines in row 1
    assert got == {0: f"start a\n{run}\nend", 1: "other\nlast", 2: "x", 3: ""}
    found = line_dedup.dedup_lines(odd).orderBy("doc_id").collect()
    assert len(found) == odd.count() and line_dedup.dedup_lines(odd.limit(0)).count() == 0
    # equal texts: the second of two ids, and one of two rows of one id (of fewer words than a run, it stays)
    assert [r["n_removed"] for r in found] == [0] * 7 + [1, 0, 0]
    twice = make(spark, [f"{run}\n\n{run} ten", f"{run}\n\n{run} ten", f"\n{run}"], [None, None, 5])
    assert sorted((r["doc_id"] is None, r["text"]) for r in line_dedup.dedup_lines(twice).collect()) == [(False, f"\n{run}"), (True, ""), (True, f"{run} ten")]


def repeats_by_brute_force(texts):
    """What is left of texts without the runs of line_dedup.WINDOW words or more that began before."""
    places, out = {}, []
    full = [[i for i, x in enumerate(t.split("\n")) if x.split()] for t in texts]
    for d, text in enumerate(texts):
        lines = text.split("\n")
        for a in range(len(full[d])):
            for b in range(a + 1, len(full[d]) + 1):
                places.setdefault(tuple(lines[i] for i in full[d][a:b]), (d, a))
    for d, text in enumerate(texts):
        lines, gone = text.split("\n"), set()
        for a in range(len(full[d])):
            for b in range(a + 1, len(full[d]) + 1):
                run = tuple(lines[i] for i in full[d][a:b])
                if sum(len(x.split()) for x in run) >= line_dedup.WINDOW and places[run] < (d, a):
                    gone.update(full[d][a:b])
        held = False
        for i in range(len(lines)):
            held = i in gone if i in full[d] else held
            if held:
                gone.add(i)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    """A run of short lines, each of which occurs before in another context, one of one-word lines with blank lines between, and random lines."""
    short = ["a b c d", "e f g h i", "j k l m"]
    words = "n o p q r s t u v".split()
    texts = [f"x{i} x\n{line}\ny{i} y" for i, line in enumerate(short)] + ["\n".join(["p1", *short, "q1"]), "\n".join(["p2", *short, "q2"])]
    texts += ["\n\n\n".join(words), "r1\n" + "\n\n \n".join(words) + "\nr2"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make(spark, texts)).collect()}
    assert got[3] == texts[3] and got[4] == "p2\nq2" and got[6] == "r1\nr2"
    assert [got[i] for i in range(len(texts))] == repeats_by_brute_force(texts)
    rng = random.Random(4)
    lines = [" ".join(f"w{rng.randrange(9)}" for _ in range(n)) for n in (0, 0, 1, 1, 2, 3, 4, 4, 5, 7, 9)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    texts += ["\n".join(rng.choice(lines[-2:]) for _ in range(140))]  # more than 64 lines, and a run that repeats itself
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == repeats_by_brute_force(texts)


def test_mixing(spark, odd):
    rng = random.Random(2)
    docs = make(spark, ["w " * rng.randrange(200) for _ in range(600)])
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert sum(targets.values()) == pytest.approx(total)
    for s, t in targets.items():
        assert sum(r["taken"] for r in rows if r["source"] == s) == pytest.approx(t, abs=220)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    mixed = mixing.mix(odd)
    assert mixed.count() == odd.count()
    assert mixing.repeated(odd).count() == mixed.agg(F.sum("copies")).first()[0]


def test_decontamination(spark, odd):
    item = "Then Anna Smith bought 12 apples for 30 dollars while her cousin Bert ate 7 kg of bread before noon."
    again = "Then Clara bought 15 apples for 44 dollars while her cousin Dave ate 9 kg of bread before noon."
    mixed = "Then Anna Smith bought 12 apples and left. Much later her cousin came."
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    docs = make(spark, [f"Before that. {item} After.", f"So. {again}", mixed, None, "nothing here at all"])
    got = {(r["doc_id"], r["item_id"], r["same_fillers"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(0, 1, True), (1, 1, False)}
    assert decontaminate.keep_clean(odd, items).count() == odd.count()


def test_decontamination_counts_each_items_own_windows(spark):
    heavy = "Sum 14 15 16 17 18 19 20 21 22 then compare the larger total now"  # of 14 windows few are usable
    arithmetic = "12 + 7 * 31 - 4 = 50"
    short = "what is this called"
    long = "The old miller carried seven heavy sacks of grain along the narrow river path to the market before anyone what is this called"
    names = "Then Anna gave the small box to Bert and later on Anna went back to the old house by the river where Anna had left a lamp"
    items = spark.createDataFrame(list(enumerate([heavy, arithmetic, short, long, names])), "item_id long, text string")
    clean = "we saw how the old miller carried seven heavy sacks and left"  # 7 running tokens of the long item are too few
    slip = names.replace("Anna", "Clara", 2).replace("Anna", "Dora").replace("Bert", "Emil")
    texts = [f"Well. {heavy} end", f"so {arithmetic} it was", arithmetic.replace("31", "32"), clean, f"well {short} here", f"So. {slip}", None]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(make(spark, texts), items).collect()}
    assert sorted(got) == [(0, 0), (1, 1), (4, 2), (5, 4)]
    assert got[0, 0]["matched"] == got[0, 0]["windows"] < 4 and got[0, 0]["same_fillers"]
    assert got[1, 1]["coverage"] == 1 and got[1, 1]["same_fillers"]
    assert 4 <= got[5, 4]["matched"] < got[5, 4]["windows"] and not got[5, 4]["same_fillers"]


def test_sharding(spark, odd):
    tree = sharding.layout(40)
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard(docs, tree).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert len(by) == 40 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert 120 < min(map(len, by.values())) and max(map(len, by.values())) < 290
    assert 120 < sum(r["grown_shard"] == 40 for r in rows) < 290
    assert sharding.shard(odd, tree).count() == odd.count()


def test_url_filter(spark):
    rules = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/")]
    urls = ["http://A.Example.org/es/1", "https://x.org/a?b#c", "nothing", None, "http://bad.net/1", "http://good.net/1", "http://x.org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([("bad.net", 1)] * 60 + [("good.net", 0)] * 60, "host string, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, outcomes, rules).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("x.org", "/a", "org/", "allow")
    assert got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4][3] == "block" and got[5][3] == "allow" and got[6] == ("x.org", "", None, "allow")


def awkward(spark):
    """Rows without and with repeated ids, equal rows, and columns with the names that helpers might use."""
    run = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu"
    rows = [(None, run), (None, run), (None, "other words of a row without an id at all here"), (5, run), (5, run), (5, "the same id with a text of its own to be kept"), (6, run.upper()), (7, None), (7, ""), (8, "one more text that nobody else has in this table")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    for name in ("_id", "id", "mark", "_n", "n", "_key", "_copy", "_row", "row", "first", "times", "found", "shard", "region", "place"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


def test_stages_keep_awkward_rows(spark):
    docs = awkward(spark)
    listed = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("_id != '_id' or n != 'n' or first != 'first'").count() == 0
    texts = [r["text"] for r in kept.where("doc_id = 5").collect()]
    assert len(texts) == 2 and len(set(texts)) == 2 and kept.where("doc_id = 6").count() == 0
    # rows without an id link as others do: two are copies of a row that has one
    assert kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 7").count() == 2
    unknown = docs.where("doc_id is null")
    assert jaccard_join.keep_one(unknown).count() == 2
    items = spark.createDataFrame([(1, docs.first()["text"])], "item_id long, text string")
    clean = decontaminate.keep_clean(docs, items)
    assert clean.columns == docs.columns
    assert listed(clean) == [x for x in listed(docs) if "alpha" not in x[2]]  # capitals are names
    mixed = mixing.repeated(docs)
    assert mixed.columns == docs.columns and mixed.where("_copy != '_copy' or times != 'times'").count() == 0
    assert mixed.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]
    named = language.keep_identified(docs)
    assert named.columns == docs.columns and named.where("_key != '_key' or found != 'found'").count() == 0
    whole = sharding.shard(docs, sharding.layout(4), whole=True)
    assert {*docs.columns} < {*whole.columns} and listed(whole) == listed(docs) and whole.schema["shard"].dataType.simpleString() == "int"


def test_shards_equal_independent_descent(spark):
    """Regions, racks and shards drawn in plain Python, with one rack's weight changed: rows move only into or out of its region."""
    import hashlib
    import math

    def draw(level, children, key):
        score = lambda name: -math.log((int(hashlib.md5(f"{level}:{name}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / children[name]
        return min(children, key=lambda name: (score(name), name))

    def descend(tree, key):
        weights = lambda rows, name: {n: sum(x.weight for x in rows if name(x) == n) for n in dict.fromkeys(map(name, rows))}
        region = draw("region", weights(tree, lambda x: x.region), key)
        inside = [x for x in tree if x.region == region]
        rack = draw("rack", weights(inside, lambda x: x.rack), key)
        inside = [x for x in inside if x.rack == rack]
        return int(draw("shard", weights(inside, lambda x: str(x.shard)), key))

    tree = sharding.layout(40)
    docs = make(spark, [f"text {i}" for i in range(400)] + [None])
    rows = sharding.shard(docs, tree).collect()
    for r in rows:
        text = f"text {r['doc_id']}" if r["doc_id"] < 400 else ""
        assert r["shard"] == descend(tree, r["doc_id"]) and r["grown_shard"] == descend(sharding.grow(tree), r["doc_id"])
        assert r["text_crc32"] == zlib.crc32(text.encode()) and r["size"] == len(text) + 16
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.rack == "k1" else 1.0) for x in tree]
    moved = [(descend(tree, i), descend(heavier, i)) for i in range(4000)]
    region = {x.shard: x.region for x in tree}
    rack = {x.shard: x.rack for x in tree}
    assert all(a == b or region[b] == "r0" for a, b in moved)  # only r0 grew
    assert all(a == b or rack[b] == "k1" for a, b in moved if region[a] == region[b] == "r0")
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, heavier).collect()}
    assert all(got[i] == moved[i][1] for i in range(400))


def test_pipeline_stages(spark):
    """Each stage on what the one before left, against what plain Python expects of it."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {name: None for name, _ in corpus_pipeline.STAGES}
    now = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, sf)
        path = corpus_pipeline.scratch(spark, f"test-{name}")
        now.write.parquet(path)
        now = spark.read.parquet(path)
        rows[name] = now.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))} if (t or "").split() else set()
    before = {r["doc_id"]: shingles(r["text"]) for r in rows["language_id"]}
    kept = {r["doc_id"] for r in rows["jaccard_join"]}
    # of what went, each is linked to a smaller or kept one; no two kept ones are linked
    linked = lambda a, b: before[a] and 100 * len(before[a] & before[b]) >= 80 * len(before[a] | before[b])
    assert all(any(linked(a, b) for b in before if b != a) for a in before if a not in kept)
    assert not any(linked(a, b) for a in kept for b in kept if a < b)
    gone = {r["doc_id"] for r in rows["jaccard_join"]} - {r["doc_id"] for r in rows["decontamination"]}
    found = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert gone == found & kept
    copies = mixing.mix(spark.createDataFrame(rows["decontamination"], docs.schema)).agg(F.sum("copies")).first()[0]
    assert len(rows["mixing"]) == len(rows["sharding"]) == copies
    by = {}
    for r in rows["sharding"]:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 16
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
