"""Operators 2, 3 and 4 over whole tables against plain Python versions of what their docstrings say."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from coppice.llm import fingerprints, language, licenses, queries, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = queries.read(spark, SF, "documents").select("doc_id", "text", "lang").collect()
    return sorted((r["doc_id"], r["text"] or "", r["lang"]) for r in rows)


def prose(text):
    """Bytes of a text, A-Z as a-z, all but letters and bytes above 127 as a space."""
    return [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]


def plain_models(rows):
    counts = {}
    for text, lang in rows:
        data = prose(text)
        if len(data) > 1:
            counts.setdefault(lang, np.zeros((256, 256)))
            np.add.at(counts[lang], (data[:-1], data[1:]), 1)
    names = sorted(counts)
    models = [np.log((counts[x] + 0.01) / (counts[x] + 0.01).sum(axis=1, keepdims=True)) for x in names] + [np.full((256, 256), -math.log(48))]
    for m in models:
        m[32, 32] = 0
    return [*names, "und"], models


def plain_softmax(x):
    e = np.exp(x - np.max(x))
    return e / e.sum()


def plain_languages(pages, labelled):
    """page_id -> language, confidence, language of the text alone."""
    names, models = plain_models(labelled)
    n, rows = len(names), []
    for page, url, html in pages:
        text = re.sub(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ", html or "")
        said = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", html or "")
        said = said.group(1).lower() if said else ""
        host = re.split("[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower() if url and "://" in url else ""
        labels = host.split(".")
        double = ".".join(labels[-2:]) in url_filter.TWO_LABELS and len(labels) > 2
        suffix, domain = (".".join(labels[-2:]), ".".join(labels[-3:])) if double else (labels[-1], ".".join(labels[-2:]))
        data = prose(text)
        scores = 0.25 * np.array([m[data[:-1], data[1:]].sum() for m in models]) if len(data) > 1 else np.zeros(n)
        scores = np.maximum(scores - scores.max(), -60.0)
        p = plain_softmax(scores + np.array([0.0] * (n - 1) + [-4.0]))
        rows.append((page, host, domain, suffix, said if said in names else "?" if said else "", scores, p))
    sums = defaultdict(lambda: np.zeros(n))
    for _, host, domain, suffix, said, _, p in rows:
        for key in ((), ("suffix", suffix), ("domain", domain, suffix), ("host", host), ("said", said)):
            sums[key] = sums[key] + p
    smoothed = lambda own, above: (own + 20 * above) / (own.sum() + 20)
    whole = (sums[()] + 1) / (sums[()].sum() + n)
    told = sum(v for k, v in sums.items() if k[:1] == ("said",)) + n + 2
    out = {}
    for page, host, domain, suffix, said, scores, p in rows:
        prior = smoothed(sums["domain", domain, suffix], smoothed(sums["suffix", suffix], whole))
        own = sums["host", host]
        prior = (np.maximum(own - p, 0) + 20 * prior) / (max(own.sum() - 1, 0) + 20)
        claim = np.log((sums["said", said] + 1) / told) if said else np.zeros(n)
        posterior = plain_softmax(scores + claim + np.log(prior))
        best = int(np.argmax(posterior))
        out[page] = names[best] if posterior[best] >= 0.5 else "und", float(posterior[best]), names[int(np.argmax(p))]
    return out


def test_languages_equal_plain_python(spark, texts):
    pages = [tuple(r) for r in queries.read(spark, SF, "pages").select("page_id", "url", "html").collect()]
    pages += [(10**6, None, None), (10**6 + 1, "no scheme", "<html lang='xx'>?</html>"), (10**6 + 2, "http://a.b.co.uk/x", "")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = plain_languages(pages, {(t, lang) for _, t, lang in texts if t and lang})
    got = language.identify_pages(rows, queries.read(spark, SF, "documents")).collect()
    assert len(got) == len(pages) and len({r["language"] for r in got}) > 3
    for r in got:
        name, sure, by_text = want[r["page_id"]]
        assert r["confidence"] == pytest.approx(sure, abs=1e-4)
        assert r["language"] == name and r["text_language"] == by_text


def plain_words(text):
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def bag(words):
    return Counter(zip(words, words[1:], strict=False))


def plain_scan(docs, templates):
    out = []
    for doc_id, text in docs:
        units = [("line", i, x) for i, x in enumerate(text.split("\n"))]
        units += [("paragraph", i, x) for i, x in enumerate(re.split("\n\n+", text))] if "\n\n" in text else []
        units += [("document", 0, text)] if "\n" in text else []
        own = plain_words(text)
        for name, body in templates.items():
            wanted = bag(plain_words(body))
            t, windows = sum(wanted.values()), []
            for kind, at, unit in units:
                have = bag(plain_words(unit))
                shared, s = sum((have & wanted).values()), sum(have.values())
                if s and 200 * shared >= 80 * (s + t):
                    out.append((doc_id, kind, at, name, shared, round(2 * shared / (s + t), 9)))
            for at in range(len(own) - 1):
                if (own[at], own[at + 1]) in wanted:
                    have = bag(own[at : at + t + 1])
                    shared, s = sum((have & wanted).values()), sum(have.values())
                    if 200 * shared >= 80 * (s + t):
                        windows.append((-2 * shared / (s + t), at, s, shared))
            taken = []
            for rank, at, _, shared in sorted(windows):
                if all(abs(at - x) > t for x in taken):
                    taken.append(at)
                    out.append((doc_id, "window", at, name, shared, round(-rank, 9)))
    return sorted(out)


def test_licences_equal_plain_python(spark, texts):
    isc, gpl = licenses.TEMPLATES["ISC"], licenses.TEMPLATES["GPL-3.0 header"]
    more = [(10**6, f"{isc}\n\n{isc.replace('software', 'program', 1)}\n\n\nend"), (10**6 + 1, f"a b c {gpl} d e f {gpl.upper()} g"), (10**6 + 2, "MIT"), (10**6 + 3, ""), (10**6 + 4, gpl.replace(" ", "\n", 9))]
    docs = [(i, t) for i, t, _ in texts] + more
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted((r["doc_id"], r["kind"], r["at"], r["license"], r["shared"], r["dice"]) for r in got.collect())
    assert got == plain_scan(docs, licenses.TEMPLATES)
    assert {x[1] for x in got} == {"line", "paragraph", "document", "window"}


def test_fingerprints_of_edited_texts(spark, texts):
    got = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, SF).collect()}
    down = [(i, t) for i, t, _ in reversed(texts)]
    edited = {}
    for (i, text), (_, following) in zip(down, [*down[1:], down[0]], strict=True):
        half = len(text) // 2
        edited[i] = text[: len(text) - half] + following[:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
    assert len(got) == len(texts)
    # an edited text has the fingerprint that it would have as a document
    again = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(spark.createDataFrame(sorted(edited.items()), "doc_id long, text string")).collect()}
    assert all(got[i]["edited_fingerprint"] == again[i] for i in edited)
    by_text = defaultdict(set)
    for i, text, _ in texts:
        by_text[text].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    counts = lambda text: Counter(w for w in re.split(r"[\x20\x09-\x0d]+", text) if w)
    off = {"near_edited": [], "near_next": []}
    for (i, text), (_, following) in zip(down, [*down[1:], down[0]], strict=True):
        for name, other in (("near_edited", edited[i]), ("near_next", following)):
            a, b = counts(text), counts(other)
            whole = sum((a | b).values())
            true = sum((a & b).values()) / whole if whole else 1.0
            off[name].append(got[i][name] - true)
            # 48 samples: five standard deviations, and none at all for equal bags or bags without a common word
            assert abs(off[name][-1]) <= 5 * math.sqrt(true * (1 - true) / 48) + 0.021
    assert all(abs(np.mean(x)) < 0.02 for x in off.values())
