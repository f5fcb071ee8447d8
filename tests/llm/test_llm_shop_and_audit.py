"""Change points, fingerprints and the filter audit against brute-force versions, and on odd input; token ids by fuzz."""

import hashlib
import math
import random
import unicodedata
from collections import Counter
from datetime import datetime, timedelta
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import changepoints, filteraudit, fingerprints, tokenfile, tokens

# --- 11


def brute_segments(values, least, penalty):
    """The best of all ways to cut, compared by cost, number of segments and starts from the last one backwards."""

    def cost(a, b):
        n, s, q = b - a, sum(values[a:b]), sum(v * v for v in values[a:b])
        return n * math.floor(1000 * math.log(1 + (n * q - s * s) // (n * n)))

    n = len(values)
    ways = [[0]] if n < 2 * least else []
    if not ways:
        todo = [[0]]
        while todo:
            starts = todo.pop()
            ways.append(starts)
            todo += [[*starts, k] for k in range(starts[-1] + least, n - least + 1)]
    priced = [(sum(cost(a, b) for a, b in zip(w, [*w[1:], n])) + penalty * (len(w) - 1), len(w), w[::-1]) for w in ways]
    best = min(priced)
    return best[2][::-1], best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60) | st.just(0), min_size=1, max_size=17), min_size=1, max_size=4), st.sampled_from([0, 40, 3000, 10_000]), st.integers(2, 5))
def test_segments_are_the_best_of_all(series, penalty, least):
    params = changepoints.SegmentParams(min_days=least, penalty=penalty)
    got = changepoints.segment([np.array(s, np.int64) for s in series], params)
    assert got == [brute_segments(s, least, penalty) for s in series]


def test_sums_beyond_64_bits():
    values = [10**10 * (k % 3) + (k > 9) * 4 * 10**11 for k in range(16)]
    assert changepoints.segment([np.array(values, np.int64)], changepoints.SegmentParams()) == [brute_segments(values, 5, 10_000)]


def test_series_of_odd_rows(spark):
    day = datetime(2024, 1, 1, 23, 59)
    rng = random.Random(4)
    rows = [(v, "kept" if rng.random() < 0.7 else "swapped", day + timedelta(days=rng.randrange(40)), rng.randrange(30) + 30 * (v == 7)) for v in [7] * 300 + [8] * 30 + [None] * 40]
    rows += [(7, "returned", day, 99), (7, None, day, 99), (7, "kept", None, 5), (7, "kept", day, None), (9, "kept", day, 4), (10, "kept", day, None)]
    rows += rows[:20]
    lines = spark.createDataFrame(rows, "vendor_id long, flag string, shipped_at timestamp_ntz, quantity int")
    lines = lines.select("*", F.lit("x").alias("day"), F.lit("y").alias("total"), F.lit("z").alias("key"))
    got = {}
    for r in sorted(changepoints.vendor_segments(lines).collect(), key=lambda r: (r.vendor_id or -1, r.segment_no)):
        got.setdefault(r.vendor_id, []).append(r)
    assert set(got) == {7, 8, 9, None}
    for vendor, found in got.items():
        sums = Counter()
        for v, flag, at, quantity in rows:
            if v == vendor and flag in ("kept", "swapped") and at is not None and quantity is not None:
                sums[(at - datetime(1970, 1, 1)).days] += quantity
        values = [sums[d] for d in range(min(sums), max(sums) + 1)]
        starts, cost = brute_segments(values, 5, 10_000) if len(values) < 17 else changepoints.segment([np.array(values)], changepoints.SegmentParams())[0]
        assert [r.first_day - min(sums) for r in found] == starts and {r.best_cost for r in found} == {cost}
        assert [r.total for r in found] == [sum(values[a:b]) for a, b in zip(starts, [*starts[1:], len(values)])]
        assert sum(r.cost for r in found) + 10_000 * (len(found) - 1) == cost and [r.segment_no for r in found] == [*range(1, len(found) + 1)]
    assert changepoints.vendor_segments(lines.limit(0)).count() == 0


# --- 12


def bag(text):
    return Counter(p.strip() for p in fingerprints.paragraph_pattern().findall(text))


def likeness(a, b):
    n = sum(a.values()) + sum(b.values())
    return 1 - (sum((a - b).values()) + sum((b - a).values())) / max(n, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b.", "c!?", "\n", "dd", "é", "...", " ", "f.g"]), max_size=60).map(" ".join), min_size=1, max_size=8), st.sampled_from([3, 6, 24]))
def test_peeling_recovers_every_difference(texts, cells):
    digests = fingerprints.Digests(texts, fingerprints.paragraph_pattern())
    left, right = map(np.ravel, np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    got = fingerprints.compare(digests, left, digests, right, cells)
    for k, (a, b) in enumerate(zip(left, right)):
        a, b = bag(texts[a]), bag(texts[b])
        assert got["only_left"][k] == sum((a - b).values()) and got["only_right"][k] == sum((b - a).values())
        assert math.isclose(got["likeness"][k], likeness(a, b), abs_tol=1e-12)


def test_fingerprints_tell_their_differences():
    texts = [" ".join(f"w{k}." for k in range(400)), " ".join(f"w{k}." for k in range(5, 400)) + " new. new.", "", "other. text."]
    digests = fingerprints.Digests(texts, fingerprints.paragraph_pattern())
    sketches = fingerprints.Sketches.of(digests, np.arange(4), 96)
    told = [fingerprints.as_text(int(n), cells) for n, cells in zip(digests.counts(), sketches.bytes())]
    values = [set(digests.values[a:b].tolist()) for a, b in zip(digests.bounds, digests.bounds[1:])]
    only = fingerprints.difference(told[0], told[1])
    assert only == (sorted(values[0] - values[1]), sorted(values[1] - values[0])) and [*map(len, only)] == [5, 2]
    assert fingerprints.difference(told[2], told[3]) == ([], sorted(values[3])) and fingerprints.difference(told[0], told[3]) is None


def test_a_cell_that_passes_by_chance_ends(monkeypatch):
    monkeypatch.setattr(fingerprints, "checks", lambda values: np.zeros(len(values), np.uint32))
    texts = [" ".join(f"{c}{k}." for k in range(n)) for c, n in (("a", 90), ("b", 91), ("c", 3))]
    digests = fingerprints.Digests(texts, fingerprints.paragraph_pattern())
    got = fingerprints.compare(digests, np.array([0, 0, 1]), digests, np.array([1, 2, 2]))
    assert (got["only_left"] - got["only_right"]).tolist() == [-1, 87, 88]


def check_fingerprints(rows, found):
    """``rows``: (doc_id, text) in order."""
    expected = []
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1] or ""
        text = text or ""
        n = len(text) // 4
        new = text[: len(text) - n] + following[:n]
        near = [round(likeness(bag(text), bag(x)), 9) for x in (new, following)]
        expected.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), *near))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_fingerprints_of_odd_documents(spark, odd_documents):
    rows = sorted(((r.doc_id, r.text) for r in odd_documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    found = fingerprints.fingerprint_documents(odd_documents).collect()
    check_fingerprints(rows, found)
    one = [r for r in found if r.doc_id == 0]
    assert len(one) == 2 and one[0].fingerprint == one[1].fingerprint
    digests = fingerprints.Digests([rows[1][1]], fingerprints.paragraph_pattern())
    sketch = fingerprints.Sketches.of(digests, np.arange(1), fingerprints.CELLS)
    assert one[0].fingerprint == fingerprints.as_text(int(digests.counts()[0]), sketch.bytes()[0])
    assert fingerprints.fingerprint_documents(odd_documents.limit(0)).count() == 0
    check_fingerprints([(4, "only one. text")], fingerprints.fingerprint_documents(spark.createDataFrame([(4, "only one. text")], "doc_id long, text string")).collect())


def test_fingerprints_of_many_ranges(spark):
    rng = random.Random(6)
    words = ["tree", "lake", "hill.", "sky", "stone\n", "river!", "ä"]
    rows = [(i * 3 - 500, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(700)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5)
    check_fingerprints(rows, fingerprints.fingerprint_documents(docs).collect())


# --- 13


def brute_audit(docs, labels):
    """Each order run for itself."""
    good = {d for d, quality, _ in labels if quality == 1}
    toxic = {d for d, _, t in labels if t == 1}
    rows = []
    for doc, text, lang in docs:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs),
        }
        rows.append((lang or "", doc, {f for f in fails if fails[f]}))
    out = {}
    for part in {r[0] for r in rows}:
        removed = Counter()
        for order in map("".join, permutations("ABCDE")):
            alive, gone = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                here = [r for r in alive if f in r[2]]
                redundant = sum(f in r[2] for r in gone)
                alive, gone = [r for r in alive if f not in r[2]], gone + here
                removed[f] += len(here)
                unique = sum(r[2] == {f} for r in rows if r[0] == part)
                out[part, order, step] = [len(alive), len(here), redundant, unique, sum(r[1] in good for r in here), sum(r[1] in toxic for r in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return out


def test_audit_against_every_order(spark, odd_documents):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(160)] + ["ABC", "#", "x|y"]
    docs = [(k, " ".join(rng.choice(words[: rng.choice((40, 160, 163))]) for _ in range(rng.choice((20, 110, 200)))), rng.choice(["en", "de", None, ""])) for k in range(60)]
    docs += [(100 + k, docs[k % 7][1], "en") for k in range(40)] + [(3, docs[3][1], "en"), (None, docs[0][1], "de"), (None, None, None), (200, None, "en"), (201, "", "de")]
    docs += [(r.doc_id, r.text, r.lang) for r in odd_documents.collect()]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in [*range(0, 140, 2), 4, None]]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").select("*", *[F.lit(1).alias(c) for c in ("part", "key", "mask", "n", "id", "good", "toxic")])
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filteraudit.audit_documents(frame, told).collect()
    named = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): [r[c] for c in named] for r in got} == brute_audit(docs, [r for r in labels if r[0] is not None])
    assert len(got) == 3 * 600
    assert filteraudit.audit_documents(frame.limit(0), told).count() == 0
    assert {r.good_lost for r in filteraudit.audit_documents(frame, told.limit(0)).select("good_lost").distinct().collect()} == {0}


def test_parity_sums_invert(spark):
    rng = random.Random(3)
    counts = [rng.randrange(1000) for _ in range(16)]
    rows = spark.createDataFrame([("p", m, n) for m, n in enumerate(counts)], "part string, mask int, n long")
    sums = filteraudit.parity_sums(rows, 4, ["part"])
    assert sums.first().sums[0] == sum(counts)
    assert sums.select(filteraudit.cells_of(F.col("sums"), 4).alias("c")).first().c == counts


# --- 5 and 7: ids


ODD_LETTERS = [
    c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)])
    if len(c.lower()) != 1 or len(c.upper()) != 1 or len(c.casefold()) != 1 or unicodedata.normalize("NFC", c) != c
]


@pytest.fixture(scope="module")
def encoder():
    return tokens.TextEncoder(tokens.default_tokenizer())


def same_ids(encoder, text):
    got = np.frombuffer(encoder.encode(text), "<u4").tolist()
    assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_ids_of_letters_that_change_with_their_case(encoder):
    letters = [*ODD_LETTERS, "é", "Å", "Α͂", "ς", "Σ"]
    for c in letters:
        for text in (c + ".", c + ",", "a" + c + ".", c.upper() + ".", f"X{c}, y{c}. Z"):
            same_ids(encoder, text)
    rng = random.Random(5)
    pools = (letters, [chr(k) for k in range(0x300, 0x370)], list("abzAZßéIıİ漢あ"), list(".,!?-'\"\n\t 5½\xa0\x1c"))
    for _ in range(60_000):
        same_ids(encoder, "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 9))))


def test_token_files_of_ids_that_are_text(spark):
    docs = spark.createDataFrame([("7", "a b"), ("x", "c"), (None, "d")], "doc_id string, text string")
    assert sorted((r.doc_id, r.start) for r in tokenfile.encode_and_read_back(docs).where("doc_id is not null").collect()) == [(7, 4)]
    assert tokenfile.encode_and_read_back(docs).count() == 3
