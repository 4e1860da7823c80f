import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.llm import conversations, decontaminate, fingerprints, jaccard_join, language, licenses, line_dedup, manifest, mixing, oracle, queries, setsketch, sharding, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_manifest", "op12_conversations"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    found = con.execute(oracle.ORACLE[name])
    columns = [x[0] for x in found.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(found.fetchall())


# --- manifest ----------------------------------------------------------------------------------------------------
def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row[0], row[3], row[2], None if row[4] is None else row[4] + more, row[1]]
    return hashed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([hashed(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def path(of, i, fanout):
    out = []
    for level in of[:-1]:
        first = i // fanout * fanout
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
        i //= fanout
    return out


@pytest.mark.parametrize("fanout, sizes", [(2, {"en": 37, None: 9, "de": 1, "fr": 64, "": 2}), (3, {"en": 29, "de": 81}), (5, {"é": 126, "z": 5}), (2, {None: 1})])
def test_manifest_equals_plain_trees(spark, fanout, sizes):
    rng = random.Random(fanout)
    rows = []
    for lang, n in sizes.items():
        rows += [(rng.choice([i, i, i, 3, None]), rng.choice(["text", "", None, "wörter \U0001f642", f"t{i}"]), lang, rng.choice(["s", None]), rng.choice([i, None, 2**63 - 1])) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("a clash")).withColumn("tag", F.lit(1))
    more = F.when(F.col("doc_id") % 5 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    # parts of 4 rows: a group's ranges are merged in more than one round where there are more than 64
    got = manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": more}, fanout=fanout, bits=2 if fanout == 2 else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in groups[g]], fanout) for g in order}
    top = levels([trees[g][-1][0] for g in order], fanout)
    want = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            way = path(trees[g], i, fanout) + path(top, k, fanout)
            now = leaf(r, int(r[0] is not None and r[0] % 5 == 0))
            for before, after in way:
                now = hashed(before, now, after)
            want.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], hashed(*[b + a for b, a in way]), now, now == top[-1][0]))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_mountain_ranges_join_to_the_whole():
    for fanout in (2, 3, 7):
        for n in (1, 2, 3, 8, 9, 50, 343):
            leaves = [hashed(str(i)) for i in range(n)]
            whole = levels(leaves, fanout)
            rng = random.Random(n)
            cuts = sorted({0, n, *(rng.randrange(n) for _ in range(6))})
            peaks = [p for a, z in zip(cuts, cuts[1:]) for p in manifest.carried(((0, i, leaves[i]) for i in range(a, z)), fanout)[1]]
            made, peaks = manifest.carried(peaks, fanout)
            short, root = manifest.closed(peaks, n, fanout)
            assert root == whole[-1][0]
            assert all(whole[level][place] == x for level, place, x in made + short)
            for a, z in zip(cuts, cuts[1:]):  # what a part asks for exists
                assert all(place < len(whole[level]) for level, place in manifest.needed(a, z - a, n, fanout))


# --- conversations -----------------------------------------------------------------------------------------------
def one_space(x):
    return " " if x is None else str(x)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{one_space(conv)}:{one_space(turn)}".encode()) % 20
        role, text = one_space(role), one_space(text)
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """By all edits from the back, with the letters that follow."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserted):
        ways, after = [], 3 if state == 2 else 2
        if i == len(rows):
            ways += [(0, "")] if state in (0, 3) else []
        else:
            cut = int(faults[i] == "truncated")
            ways.append((3, "D", best(i + 1, state, 0)))
            if faults[i] not in ("blank", "duplicate"):
                ways.append((2 + cut, "R", best(i + 1, after, 0)))
                kind = rows[i][1][:1]
                if (kind, state) in (("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)):
                    ways.append((cut, "K", best(i + 1, {"s": 1, "u": 2, "a": 3}[kind], 0)))
        if inserted < 3:
            ways.append((2, "I", best(i, after, inserted + 1)))
        ways = [w if len(w) == 2 else (w[0] + w[2][0], w[1] + w[2][1]) for w in ways if len(w) == 2 or w[2]]
        return min(ways) if ways else None

    for i in range(len(rows), 0, -100):  # no deep recursion
        best(i, 0, 0)
    cost, audit = best(0, 0, 0)
    state, i, lines = 0, 0, []
    for edit in audit:
        role = "assistant" if state == 2 else "user"
        if edit in "IR":
            lines.append(role + ":" + (rows[i][2] if edit == "R" else ""))
            state = 3 if state == 2 else 2
        elif edit == "K":
            lines.append(f"{rows[i][1]}:{rows[i][2]}")
            state = {"s": 1, "u": 2, "a": 3}[rows[i][1][0]]
        i += edit != "I"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashed("\n".join(lines))


REPAIRED = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repairs_equal_brute_force(spark):
    rng = random.Random(5)
    data = []
    for conv in [None, *range(60), 99]:
        for i in range(400 if conv == 99 else rng.choice([1, 2, 3, 6, 20])):
            data.append((conv, rng.choice([None, i, i, i, rng.randrange(5)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unit"]), rng.choice(["a b.", "c d", "e!", " ", None, "", "f g", "x?\n", f"the end {i}"])))
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("tag", F.lit(1)).withColumn("mark", F.lit("x"))
    mark = lambda r: hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()
    groups = {c: [] for c, *_ in data}
    for conv, *r in damage(data):
        groups[conv].append(tuple(r))
    want = {c: cheapest(sorted(r, key=lambda r: (r[0] is not None, r[0] or 0, mark(r)))) for c, r in groups.items()}
    broken = conversations.damaged(rows)
    # blocks of 8 rows: conversations of several blocks are chained
    got = {r["conv_id"]: tuple(r[c] for c in REPAIRED) for r in conversations.repair(broken, every=rows, bits=3).collect()}
    assert got == want
    lines = {}
    for r in conversations.repaired(broken, bits=3).orderBy("place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert all(hashed("\n".join(lines.get(c, []))) == w[-1] for c, w in want.items())
    assert all(w[1:6] == (0,) * 5 and not w[6] for c, w in want.items() if not groups[c])
    assert conversations.repair(rows.limit(0), every=rows.limit(0)).count() == 0


def test_repairs_of_given_conversations(spark):
    say = lambda kinds: [(i, {"s": "system", "u": "user", "a": "assistant", "x": "tool"}[k.lower()], f"row {i}" + ("" if k.isupper() else ".")) for i, k in enumerate(kinds)]
    # the answer of each, by hand
    wanted = {"ua": (0, "KK"), "sua": (0, "KKK"), "u": (2, "KI"), "a": (2, "IK"), "uu": (2, "KR"), "s": (3, "D"), "xa": (2, "RK"), "uaUA": (2, "KKKK"), "uax": (3, "KKD"), "su": (2, "KKI"), "aa": (2, "RK")}
    rows = [(i, *r) for i, kinds in enumerate(wanted) for r in say(kinds)]
    got = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in got} == dict(enumerate(wanted.values()))


# --- SetSketch ---------------------------------------------------------------------------------------------------
def test_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    tokens = setsketch.mix(rng.integers(0, 1 << 62, 4000).astype(np.uint64))
    for share in (0.5, 0.8, 0.95):
        both = int(1000 * share)
        a, b = tokens[: 1000 + both], np.concatenate([tokens[1000 : 1000 + both], tokens[2000:3000]])
        r = setsketch.registers(setsketch.least_hashes([a, b, np.union1d(a, b)]))
        assert (setsketch.merged(r[0], r[1]) == r[2]).all()
        jaccard = both / (2000 + both)
        n = (np.array([float(len(a))]), np.array([float(len(b))]))
        found = setsketch.estimated(n, np.array([(r[0] > r[1]).sum()]), np.array([(r[0] < r[1]).sum()]))[0]
        assert abs(found - jaccard) < 5 * (jaccard * (1 - jaccard) / setsketch.REGISTERS) ** 0.5
    # one large set by itself has the same registers as among others
    large = setsketch.mix(rng.integers(0, 1 << 62, 3 * setsketch.STEP).astype(np.uint64))
    alone, among = setsketch.least_hashes([large]), setsketch.least_hashes([tokens[:5], large, tokens[:7]])
    assert (alone[0] == among[1]).all()


def brute_components(rows, k, percent):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else []) for w in words]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(sets[a]), least.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(rows)]


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(None, "one row without an id of some words"), (None, "One row without AN id of some words"), (None, "x"), (90, None), (91, ""), (92, "  "), (93, "one"), (94, "one"), (95, "one two"), (95, "one two")]
    for g in range(14):
        base = rng.choices(vocabulary, k=rng.choice([3, 20, 60, 200]))
        shared = rng.choices(vocabulary, k=30)
        for _ in range(8):
            copy = list(base) + (shared if g % 2 else [])
            for _ in range(rng.choice([0, 1, 2, len(copy) // 25, len(copy) // 18, len(copy) // 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((100 + len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = near_copies(k)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("nid", F.lit(1)).withColumn("mark", F.lit("x"))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in setsketch.near_duplicates(docs, k=k).collect()]
    assert Counter(got) == Counter(brute_components(rows, k, 80))
    kept = setsketch.near_duplicates(docs, k=k)
    assert kept.where("kept != (doc_id <=> component_id)").count() == 0
    with pytest.raises(ValueError):
        setsketch.near_duplicates(docs, k=k, percent=70)


def test_rows_without_ids_link(spark):
    words = [f"w{i}" for i in range(101)]
    rows = [(None, " ".join(words)), (4, " ".join([*words[:-1], "other"])), (None, " ".join(words[:50])), (None, " ".join(words[:50]))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    for found in (jaccard_join.jaccard_components(docs, k=3, percent=90), setsketch.near_duplicates(docs, k=3)):
        assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found.collect()) == [(0, 0), (0, 0), (0, 4), (4, 4)]
    assert sorted(r["links"] for r in jaccard_join.jaccard_components(docs, k=3, percent=90).collect()) == [0, 0, 1, 1]
    assert jaccard_join.keep_one(docs).count() == 2


# --- all operators -----------------------------------------------------------------------------------------------
def test_empty_tables(spark):
    """Each operator of no rows gives no rows."""
    docs = spark.createDataFrame([], SCHEMA)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    seen = spark.createDataFrame([], "host string, bad int")
    found = {
        "language": language.keep_identified(docs),
        "licences": licenses.scan(docs),
        "fingerprints": fingerprints.fingerprint(docs),
        "lines": line_dedup.dedup_lines(docs),
        "mix": mixing.mix(docs),
        "repeated": mixing.repeated(docs),
        "contaminated": decontaminate.contaminated(docs, items),
        "clean": decontaminate.keep_clean(docs, items),
        "shards": sharding.shard(docs, sharding.layout(4)),
        "urls": url_filter.judge(pages, seen, []),
        "jaccard": jaccard_join.jaccard_components(docs),
        "kept": jaccard_join.keep_one(docs),
        "manifest": manifest.manifest(docs, ["doc_id", "text"], "lang", "doc_id"),
        "repair": conversations.repair(talks),
        "repaired": conversations.repaired(talks),
        "sketch": setsketch.near_duplicates(docs),
    }
    assert {name: df.count() for name, df in found.items()} == dict.fromkeys(found, 0)


def test_fingerprints_of_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, t, "en", "s", 0) for t in ("a b c", "a b c", None)], SCHEMA)
    rows = fingerprints.fingerprint(docs).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 5, 5] and len({r["fingerprint"] for r in rows}) == 2
