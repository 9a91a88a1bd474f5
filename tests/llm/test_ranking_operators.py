"""Repetition rules, ranked search and clustering against plain versions on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankloom.llm import centroids, lexical, repetition


def plain_lcp(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def repeats_by_brute_force(words, least):
    """Maximal repeats: first place, length, places; strings that go on neither to the left nor to the right."""
    out = set()
    places = defaultdict(list)
    for n in range(least, len(words)):
        for k in range(len(words) - n + 1):
            places[tuple(words[k : k + n])].append(k)
    for string, at in places.items():
        n = len(string)
        if len(at) > 1 and len({words[k - 1] if k else object() for k in at}) > 1 and len({words[k + n] if k + n < len(words) else object() for k in at}) > 1:
            out.add((at[0], n, len(at)))
    return out


def odd_texts(rnd, n):
    texts = [" ".join(rnd.choice("ab c dé E").strip() or "f" for _ in range(rnd.choice([0, 1, 2, 5, 30, 60, 90]))) for _ in range(n)]
    line = "one two three four five six seven eight nine ten"
    return texts + [None, "", " \n\t", "x", "a " * 200, "a b " * 70, f"{line}\n{line} \n{line}\n\n\n{line}", "#tag *$%&|<> a b c\x0bd\x0ce", "long " * 3 + "w" * 3000]


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_maximal_repeats(seed):
    rnd = random.Random(seed)
    texts = [[rnd.choice([b"a", b"b", b"c", b"d"][: rnd.randint(1, 4)]) for _ in range(rnd.randint(0, 40))] for _ in range(12)]
    flat, start = repetition.numbered(texts)
    s = repetition.suffixes(flat)
    whole = flat.tolist()
    assert [whole[k:] for k in s.order.tolist()] == sorted(whole[k:] for k in range(len(whole)))
    assert s.lcp.tolist() == [0] + [plain_lcp(whole[a:], whole[b:]) for a, b in zip(s.order, s.order[1:])]  # noqa: B905
    for least in (1, 2, 3):
        place, length, times = repetition.maximal_repeats(flat, s, least)
        of = np.searchsorted(start, place, "right") - 1
        got = set(zip(of.tolist(), (place - start[of]).tolist(), length.tolist(), times.tolist(), strict=True))
        assert got == {(d, *r) for d, t in enumerate(texts) for r in repeats_by_brute_force(t, least)}


def quality_by_brute_force(text, least, most_covered, longest):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def inside(n):
        windows = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        return {k + j for k in range(len(words) - n + 1) if windows[tuple(words[k : k + n])] > 1 for j in range(n)}

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside(3)), len(inside(least)))
    failed = len(words) < 50 or 100 * base[4] > 50 * len(words)
    most = max([n for n in range(1, len(words)) if inside(n)], default=0)
    return (*base, most, failed, not failed and base[5] <= most_covered * len(words) and most <= longest)


def test_quality_rules(docs_of):
    rnd = random.Random(1)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = odd_texts(rnd, 60) + [" ".join(f"w{rnd.randrange(40)}" for _ in range(300)), passage + " x " + passage + " " + " ".join(f"q{k}" for k in range(60)), passage * 2 + " z" * 10]
    texts += [f"{passage}\n" + " ".join(f"r{k}" for k in range(500)) + f"\n{passage}"]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[5]), (3, texts[7])]
    got = [tuple(r)[:8] + (r.base_failed, r.kept) for r in repetition.verdicts(docs_of(rows), least=8, most_covered=0.3, longest=25).collect()]
    want = [(i, *quality_by_brute_force(t, 8, 0.3, 25)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {x[-1] for x in want} == {True, False} and any(not x[-2] and not x[-1] for x in want)
    kept = repetition.keep_good(docs_of(rows))
    assert kept.columns == docs_of([]).columns and kept.count() == repetition.verdicts(docs_of(rows)).filter("kept").count()
    found = {(r.doc_id, r.first_word, r.length, r.times, r.passage) for r in repetition.passages(docs_of(rows), least=20).collect()}
    assert (len(texts) - 1, 0, 30, 2, passage) in found and all(len(p.split()) == n for _, _, n, _, p in found)
    assert repetition.verdicts(docs_of([])).count() == repetition.passages(docs_of([])).count() == 0


def test_quality_rules_of_a_long_text(docs_of):
    rnd = random.Random(2)
    text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(200_000))
    one = repetition.verdicts(docs_of([(1, text), (2, "again and " * 100_000)])).orderBy("doc_id").collect()
    assert [(r.n_words, r.kept) for r in one] == [(200_000, True), (200_000, False)] and one[1].longest_repeat == 199_998


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked_by_brute_force(docs, items, most):
    counts = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counts = [x for x in counts if x[2]]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, c, n in counts:
            m = 75 + (25 * n * n_docs) // total
            scores.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t]), i))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1]))[:most]
        out += [(item, k + 1, i, s) for k, (s, i) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "cells", "seed"), [(1 << 20, 1 << 22, 64), (40, 300, 1), (1 << 20, 900, 2)])
def test_ranked_search(spark, docs_of, monkeypatch, block, cells, seed):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "LEAVES", 3)
    monkeypatch.setattr(lexical, "SEED", seed)
    rnd = random.Random(5)
    words = ["al", "Be", "été", "x1", "gamma", "d", "longerword", "ΣΑ", *(f"v{k}" for k in range(60))]
    phrase = lambda n: " ,".join(rnd.choice(words) for _ in range(n))
    items = [(i, phrase(rnd.choice([1, 2, 5, 20]))) for i in range(23)] + [(23, None), (24, ""), (25, "nowhere"), (None, "al be"), (3, "Be be BE"), (26, "—d, D!")]
    items += [items[4]]
    docs = [(i, phrase(rnd.choice([0, 1, 3, 40]))) for i in range(150)]
    docs += [(200, None), (201, items[4][1].upper()), (201, items[4][1].upper()), (None, items[5][1]), (None, items[5][1]), (-4, docs[7][1]), (202, phrase(9000))]
    docs += [(300 + k, docs[9][1]) for k in range(40)]
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score int")
    got = sorted(map(tuple, lexical.ranked(docs_of(docs), benchmark, 7, block).collect()), key=str)
    want = ranked_by_brute_force(docs, [x for x in items if x[1] is not None], 7)
    assert got == want and len(want) > 100
    assert lexical.ranked(docs_of([]), benchmark).count() == lexical.ranked(docs_of(docs[:3]), benchmark.limit(0)).count() == 0


def test_dual_tree_prunes():
    """Few documents are scored when each item has its own words, and none of the best is lost."""
    rng = np.random.default_rng(4)
    items, docs, size = 16, 4096, 64
    row, term = np.repeat(np.arange(items), 4), np.arange(64)
    order, levels = lexical.item_tree(row, term, np.full(64, 1000), items)
    table = np.zeros((docs, size))
    topic = np.sort(rng.integers(0, items, docs))
    for k in range(4):
        table[np.arange(docs), 4 * topic + k] = rng.integers(1, 10**6, docs)
    best = lexical._Best(np.zeros(items, np.int64), 20)
    scored = lexical.search_batch(table, np.arange(docs), levels, best, True)
    again = lexical.search_batch(table, np.arange(docs) + docs, levels, best, True)
    assert scored < docs * items / 4 and again < scored
    for place, item in enumerate(order.tolist()):
        scores = (table[:, 4 * item : 4 * item + 4].sum(axis=1) * 1000).astype(np.int64)
        want = np.repeat(np.sort(scores)[::-1], 2)[:20]
        assert best.score[place].tolist() == want.tolist()


def clusters_by_brute_force(rows, count, rounds):
    size = 64
    held = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(held, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:count]
    middles = [v for _, v in first]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(middles)) for _, v in held]
        if turn < rounds:
            for c in range(len(middles)):
                mine = [v for (_, v), (_, at) in zip(held, near, strict=True) if at == c]
                if mine:
                    middles[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = Counter()
    for d, c in near:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles]
    return sorted((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(held, near, strict=True))


@pytest.mark.parametrize(("scale", "rows_to_a_block"), [(1.0, 256), (1e5, 7)])
def test_clusters(spark, monkeypatch, scale, rows_to_a_block):
    monkeypatch.setattr(centroids.zones, "__defaults__", (centroids.SIZE, rows_to_a_block))
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(9, 64))
    rows = [(i, [float(x) * scale for x in np.float32(middle[i % 9] + 0.2 * rng.normal(size=64))]) for i in range(300)]
    rows += [(300 + k, rows[5][1]) for k in range(80)] + [(500, None), (501, []), (502, [1.0] * 63), (503, [None] * 64), (504, [math.nan] * 64), (505, [math.inf] * 64)]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (7, rows[8][1]), (506, [0.0] * 64), (507, [-0.001] * 64)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, vec string").repartition(5)
    got = centroids.cluster(table, 12, 4).drop("compared").collect()
    assert sorted(map(tuple, got)) == clusters_by_brute_force(rows, 12, 4)
    few = centroids.cluster(table.filter("vec_id < 3")).collect()
    assert len(few) == 3 and {r.distance for r in few} == {0}
    beyond = spark.createDataFrame([(1, [1e300] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in centroids.cluster(beyond).collect()] == [2]
    assert centroids.cluster(table.limit(0)).count() == 0


def test_boxes_leave_centroids_out():
    """Candidates hold the nearest centroid of every vector in the box, and far centroids are not compared."""
    rng = np.random.default_rng(7)
    centres = rng.integers(-2000, 2000, (40, 16))
    for c in range(40):
        vectors = centres[c] + rng.integers(-40, 40, (100, 16))
        found, distance, compared = centroids.assign(vectors, vectors.min(axis=0), vectors.max(axis=0), centres)
        every = ((vectors[:, None, :] - centres[None]) ** 2).sum(axis=2)
        assert found.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()
        assert compared < 10
