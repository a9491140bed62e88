"""Exact, near and substring duplicates, licences, and components."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from chronospark.llm import common, exact_dedup, jaccard, licenses, substring_dedup
from chronospark.llm.textnum import distinct


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    joined = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in joined}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_key_filter(spark):
    keys = [(i * 7919 * 10**9) - 10**15 for i in range(100)]
    held = common.key_filter(spark.createDataFrame([(k,) for k in keys], "key long"), 1 << 12)
    assert common.may_hold(held, np.array(keys)).all()
    assert not common.may_hold(common.key_filter(spark.createDataFrame([], "key long"), 64), np.array(keys)).any()


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_exact_by_brute_force(spark, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(60)] + ["é" * 9, "é" * 9, None, "abcabc", "abcab"]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "other")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=block).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = []
    for i, t in rows:
        own = groups[t or ""]
        known = [x for x in own if x is not None]
        keep = max(known) if known else None
        want.append((str(i), str(keep), len(own), i == keep))
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == sorted(want)


def test_exact_edges(edges, empty):
    got = exact_dedup.exact_duplicates(edges)
    assert got.count() == edges.count() and exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(edges)
    assert kept.columns == edges.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r["text"] or "" for r in edges.collect()})


def test_exact_dedup_keeps_every_text_of_repeated_and_null_ids(spark):
    rows = [(None, "a"), (None, "b"), (None, "b"), (5, "a1"), (5, "b1"), (5, "b1"), (6, "c"), (None, "c"), (4, "c"), (None, None), (None, "")]
    kept = exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == [("5", "a1"), ("5", "b1"), ("6", "c"), ("None", ""), ("None", "a"), ("None", "b")]


def words_of(text, k):
    w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "").split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = [words_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_by_brute_force(spark, k, percent):
    rng = random.Random(percent)
    rows = []
    for size in (4, 9, 12, 18, 25, 40, 70, 130, 300):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
            if rng.random() < 0.3:
                w = w[: max(1, len(w) - rng.randrange(0, 3))]
            rows.append((len(rows), " ".join(w).title()))
    rows += [(None, rows[5][1]), (7, rows[7][1]), (900, ""), (901, None), (902, " \n"), (903, "a"), (904, "A")]
    got = jaccard.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k, percent=percent).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(rows, k, percent)


def test_jaccard_family_of_several_blocks(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = jaccard.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(rows, 3, 90)


def test_jaccard_edges(edges, empty):
    got = jaccard.similar_classes(edges)
    assert got.count() == edges.count() and jaccard.similar_classes(empty).count() == 0
    kept = jaccard.keep_one_of_similar(edges)
    assert kept.columns == edges.columns
    assert {r["doc_id"] for r in kept.collect() if r["text"] and "one two" in r["text"]} == {5}


def test_bands_cover_all_linked_sizes():
    for percent in (90, 80, 50):
        bands = jaccard.Bands(percent)
        sizes = np.arange(1, 3000)
        rows, band = bands.pairs(sizes)
        own = defaultdict(set)
        for s, b in zip(sizes[rows].tolist(), band.tolist(), strict=True):
            own[s].add(b)
        for s in range(1, 2000, 7):
            for t in range(s + 1, min(2999, 100 * s // percent) + 1):
                differ = 2 * t * (100 - percent) // (100 + percent)
                assert differ == 0 or own[s] & own[t], (percent, s, t)


def test_linked_counts_exactly():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    close = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b))
    assert {tuple(p) for p in jaccard.linked(sets, 60).tolist()} == {(i, j) for j in range(40) for i in range(j) if close(sets[i], sets[j])}
    assert {tuple(p) for p in jaccard.linked(sets, 60, 15).tolist()} == {(i, j) for i in range(15) for j in range(15, 40) if close(sets[i], sets[j])}


def connections(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_many_sets_are_connected_as_by_all_links(percent):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        base, common = [rng.integers(0, 1 << 62, rng.integers(1, 120)) for _ in range(6)], rng.integers(0, 1 << 62, 10)
        sets = []
        for _ in range(150):
            x = base[rng.integers(6)].copy()
            other = rng.integers(0, len(x), rng.integers(0, len(x) // 4 + 1))
            x[other] = rng.integers(0, 1 << 62 if seed % 2 else 30, len(other))
            sets.append(np.unique(np.append(x, common[: rng.integers(11)])).astype(np.uint64))
        for first in (None, 60):
            assert connections(150, jaccard.connected(sets, percent, first)) == connections(150, jaccard.linked(sets, percent, first).tolist())


def test_a_chained_family_travels_once_or_twice(spark, monkeypatch):
    """Each set but the last is near enough to some, all are one family of many blocks."""
    rng, frames = random.Random(3), []
    monkeypatch.setattr(jaccard, "saved", lambda df: frames.append(common.saved(df)) or frames[-1])
    common_words = [f"c{i}" for i in range(7)]
    rows = [(i, " ".join([*common_words, *(f"x{rng.randrange(10**9)}" for _ in range(i % 5))])) for i in range(1500)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), percent=70).collect()}
    want = brute(rows[:300], 3, 70)
    assert [(str(i), str(got[i])) for i in range(300)] == sorted([(d, c) for d, _, c in want], key=lambda x: int(x[0]))
    placed = next(f for f in frames if "band" in f.columns)
    sets = placed.select("set").distinct().count()
    assert sets > 5 * jaccard.BLOCK and placed.count() <= 3 * sets


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)).capitalize() + "."


def test_repeated_passages_are_cut_but_for_the_first(spark):
    rng = random.Random(5)
    passage = " ".join(sentence(rng, 10) for _ in range(6))
    near = passage.replace(passage.split()[13], "changed", 1)
    rows = []
    for i in range(40):
        own = [sentence(rng, rng.randint(4, 14)) for _ in range(12)]
        if i % 8 == 3:
            own.insert(rng.randrange(12), near if i == 19 else passage)
        rows.append((i, " ".join(own)))
    out = {r["doc_id"]: r for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), spans_col="spans").collect()}
    for i, t in rows:
        if i % 8 == 3 and i not in (3, 19):
            assert out[i]["text"] == t.replace(passage, "", 1) and len(out[i]["spans"]) == 1
        elif i != 19:
            assert out[i]["text"] == t and not out[i]["spans"]
    assert len(out[19]["text"]) < len(rows[19][1]) - 200


def test_passages_inside_sentences_are_cut_whole(spark):
    rng = random.Random(11)
    plain = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows, want, passages = [], {}, {}
    for k in range(60):
        passage = plain(rng.choice((25, 30, 51, 54, 57, 80)))
        for i in range(3):
            before, after = plain(rng.randint(3, 60)), plain(rng.randint(3, 60))
            rows.append((3 * k + i, f"{before} {passage} {after}"))
            want[3 * k + i] = rows[-1][1] if i == 0 else f"{before}  {after}"
            passages[3 * k + i] = passage.split()
    short = plain(24)
    for i in (200, 201):
        rows.append((i, f"{plain(40)} {short} {plain(40)}"))
        want[i] = rows[-1][1]
    out = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    unlike = 0
    for r in out.collect():
        # a paragraph with a few own words is alike as a whole
        got, own = r["text"].split(), want[r["doc_id"]].split()
        assert got == own or (r["doc_id"] % 3 and r["doc_id"] < 180 and not set(got) & set(passages[r["doc_id"]]) - set(own) and len(own) - len(got) <= 12)
        unlike += got != own
    assert unlike <= 12


def test_alike_paragraphs_among_many_unlike_ones(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    fixed, rows = [word() for _ in range(18)], []
    for i in range(300):
        # fills of a template share shingles; each comes twice, with another word in each run of GRAM words
        fill = fixed[:9] + [word() for _ in range(12)] + fixed[9:] + [word() for _ in range(10)]
        near = fill[:-1] + [word()]
        rows += [(i, "lead. " + " ".join(fill) + "."), (1000 + i, "lead. " + " ".join(near) + ".")]
    out = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    last = {i: t.split()[-1] for i, t in rows}
    p = substring_dedup.Paragraphs(pa.array([t for _, t in rows]))
    shingles, borders = p.shingles()
    ends = [set(shingles[borders[k - 1] : borders[k]].tolist()) for k in p.first[1:]]
    alike = [1000 + i for i in range(300) if ends[2 * i] and 100 * len(ends[2 * i] & ends[2 * i + 1]) >= 80 * len(ends[2 * i] | ends[2 * i + 1])]
    # an alike paragraph is cut as a whole, with its own last word
    missed = [i for i in alike if last[i] in out[i]]
    assert len(alike) > 100 and len(missed) <= 0.02 * len(alike), (len(missed), len(alike))


def test_unlike_paragraphs_of_a_value_travel_once(spark, monkeypatch):
    """Paragraphs of one phrase and other words; they were sent as often as they filled blocks of 96."""
    rng, frames = random.Random(8), []
    monkeypatch.setattr(substring_dedup, "saved", lambda df: frames.append(common.saved(df)) or frames[-1])
    phrase = "zeta eta theta iota kappa lambda mu nu xi omikron pi rho"
    rows = [(i, f"{phrase} {sentence(rng, 3)}") for i in range(1200)] + [(5000, rows_5 := f"{phrase} {sentence(rng, 3)}"), (5001, rows_5)]
    found = {r["id"] for r in substring_dedup.repeated_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 5001 in found
    blocks = [f for f in frames if "blocks" in f.columns]
    assert blocks and sum(f.count() for f in blocks) and max(r["blocks"] for f in blocks for r in f.select("blocks").where("blocks IS NOT NULL").distinct().collect()) == 1


def test_winnowed_runs_of_shared_words():
    rng = random.Random(12)
    g = substring_dedup.GRAM
    for _ in range(50):
        shared = [f"w{rng.randrange(5)}" for _ in range(2 * g - 1 + rng.randrange(40))]
        texts = [" ".join([f"{x}{i}" for i in range(rng.randrange(30))] + shared + [f"{x}{i}" for i in range(rng.randrange(30))]) for x in "ab"]
        w = substring_dedup.Words(pa.array(texts))
        places = []
        for row in (0, 1):
            at = substring_dedup.winnowed(w) - w.first[row]
            lead = texts[row].split().index(shared[0])
            places.append([int(x) - lead for x in at if lead <= x <= lead + len(shared) - g])
        both = sorted(set(places[0]) & set(places[1]))
        assert both[0] < g and both[-1] + g > len(shared) - g and all(b - a <= g for a, b in zip(both, both[1:]))


def test_runs_to_cut():
    size, repeated = np.array([10, 3, 12, 8, 9, 2, 30]), np.array([1, 0, 1, 0, 0, 0, 1], bool)
    assert substring_dedup.runs_to_cut(size, repeated, 25) == [(0, 3), (6, 7)]
    assert substring_dedup.runs_to_cut(size, repeated, 26) == [(6, 7)]
    assert substring_dedup.runs_to_cut(np.empty(0, int), np.empty(0, bool), 1) == []


def test_bands_are_tuned():
    bands, rows = substring_dedup.tuned(0.8, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99


def test_substring_edges(edges, empty):
    out = substring_dedup.without_repeats(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    rows = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (1, None) in rows and (2, "") in rows and (7, next(r["text"] for r in edges.collect() if r["doc_id"] == 7)) in rows
    assert substring_dedup.without_repeats(empty).count() == 0


def test_patience():
    assert licenses.rising([3, 1, 2, 9, 4, 5]) in ([1, 2, 4, 5],)
    assert licenses.rising([]) == []
    rng = random.Random(7)
    for _ in range(100):
        x = rng.sample(range(30), rng.randint(1, 9))
        best = max(len(s) for s in subsequences(x))
        got = licenses.rising(x)
        assert len(got) == best and all(x[a] < x[b] for a, b in zip(got, got[1:]))


def subsequences(x):
    out = [[]]
    for v in x:
        out += [s + [v] for s in out if not s or s[-1] < v]
    return out


def test_alignment_is_in_order_and_exact():
    rng = random.Random(8)
    for _ in range(200):
        template = [rng.randrange(12) for _ in range(rng.randint(1, 15))]
        words = [rng.randrange(20) for _ in range(5)] + template + [rng.randrange(20) for _ in range(5)]
        matched = licenses.align(template, words, 0, len(words))
        assert all(template[t] == words[d] for t, d in matched)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(matched, matched[1:]))


def test_licences(spark, edges, empty):
    filler = "the quick brown fox jumps over the lazy dog and the other dogs of the town . " * 20
    texts = [
        (0, filler + "Released under the MIT License. " + filler, "MIT"),
        (1, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", "Apache-2.0"),
        (2, filler + "This work is now licensed under the GNU General Public License version 3.", "GPL-3.0"),
        (3, filler + "license version public", None),
        (4, filler, None),
        (5, "Licensed under CC BY-NC 4.0. " * 3, "CC-BY-NC-4.0"),
        (6, filler + licenses.TEMPLATES[1][1] + filler, "MIT"),
    ]
    out = {r["doc_id"]: r for r in licenses.licenses(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")).collect()}
    assert {i: out[i]["license"] for i, _, _ in texts} == {i: want for i, _, want in texts}
    assert len(out[5]["found"]) == 3 and out[4]["coverage"] == 0
    assert licenses.licenses(edges).count() == edges.count() and licenses.licenses(empty).count() == 0


def licence_of(text):
    """By aligning every template with the whole text: the longest common subsequence of words instead of anchors."""
    words, out = licenses.hashes([text])[0], []
    for name, template, needed in licenses.TEMPLATES:
        t, need = licenses.hashes([template])[0], set(licenses.hashes([needed])[0])
        for first in range(len(words)):
            for last in range(first + 1, min(len(words), first + int(len(t) / 0.8) + 1) + 1):
                if words[first] not in t or words[last - 1] not in t:
                    continue
                table = [0] * (last - first + 1)
                for w in t:
                    before = 0
                    for j, v in enumerate(words[first:last], 1):
                        before, table[j] = table[j], before + 1 if v == w else max(table[j], table[j - 1])
                common = table[-1]
                if common / (len(t) + last - first - common) >= 0.8 and need <= set(words[first:last]):
                    out.append((common / (len(t) + last - first - common), name))
    return {name for c, name in out if c == max(x for x, _ in out)}


NEAR = [
    ("Released under the BSD License.", "LicenseRef-BSD"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
    ("Released under the new MIT License.", "MIT"),
    ("Released under the Boost License.", None),
    ("Licensed under the Apache License, Version 1.1.", None),
]


def test_near_misses_keep_their_names(spark):
    full = {name: text for name, text, _ in licenses.TEMPLATES if len(text) > 600}
    texts = [(t, want) for t, want in NEAR] + [(f"some words before {t} and words after it", name) for name, t in full.items()]
    texts += [(t.replace("copyright", "copyrite", 1), name) for name, t in full.items()]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.licenses(rows).collect()}
    assert [(t[:70], got[i]) for i, (t, _) in enumerate(texts)] == [(t[:70], want) for t, want in texts]


def test_licences_by_brute_force(spark):
    rng, short = random.Random(9), [t for _, t, _ in licenses.TEMPLATES if len(t) < 90]
    texts = []
    for _ in range(60):
        words = rng.choice(short).split()
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(words))
            words[i : i + rng.randrange(2)] = rng.sample(["odd", "stray", "words"], rng.randrange(2))
            words = words or ["x"]
        texts.append("aa bb " + " ".join(words) + " cc dd")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.licenses(rows).collect()}
    for i, t in enumerate(texts):
        want = licence_of(t)
        assert (got[i] is None and not want) or got[i] in want, (t, got[i], want)


def test_linked_sets_share_a_signature():
    """At the thresholds, sets of equal and of unlike sizes in all schemes."""
    rng = np.random.default_rng(10)
    for percent in (80, 90):
        bands = jaccard.Bands(percent)
        for size in (5, 12, 40, 63, 64, 100, 200, 255, 256, 500, 1500):
            for unequal in (False, True):
                for _ in range(30):
                    one = rng.integers(1, 1 << 62, size).astype(np.uint64)
                    if unequal:  # the smaller is a subset
                        other = one[: -(-size * percent // 100)]
                    else:
                        away = size * (100 - percent) // (100 + percent)
                        other = np.concatenate([one[away:], rng.integers(1, 1 << 62, away).astype(np.uint64)])
                    common = len(np.intersect1d(one, other))
                    assert 100 * common >= percent * (len(one) + len(other) - common)
                    values = [np.unique(one), np.unique(other)]
                    row, signature = jaccard.signatures(np.concatenate(values), np.append(0, np.cumsum([len(v) for v in values])), bands)
                    equal = len(values[0]) == len(values[1]) == common
                    assert equal or np.intersect1d(signature[row == 0], signature[row == 1]).size, (percent, size, unequal)


def test_a_hub_of_links(spark):
    """One node with very many links, and a chain: each component's least node."""
    edges = spark.createDataFrame([(5, 10 + i) for i in range(400)] + [(1000 + i, 1001 + i) for i in range(50)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert all(got[10 + i] == 5 for i in range(400)) and all(got[1000 + i] == 1000 for i in range(51))


def test_distinct_rows():
    values, borders = distinct(np.array([5, 5, 1, 2, 2, 9], np.uint64), np.array([0, 3, 3, 6]))
    assert values.tolist() == [1, 5, 2, 9] and borders.tolist() == [0, 2, 2, 4]


def test_no_shuffle_file_stays_behind_a_written_table(spark):
    import time
    from pathlib import Path

    def files():
        return {str(p) for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}

    before, until = files(), time.time() + 20
    made = common.saved(spark.range(10_000).selectExpr("id % 97 AS k").groupBy("k").count())
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and len(made.collect()) == 97
