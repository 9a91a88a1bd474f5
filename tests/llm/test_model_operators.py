"""Near duplicates, neighbours, chat, toxicity, language and the pipeline on small tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import chat, decontaminate, languages, neighbours, packing, simhash, suffixes, toxicity

SPACE = b"\t\n\x0b\x0c\r "


def fingerprint(text):
    words = [w for w in bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).translate(bytes(32 if c in SPACE else c for c in range(256))).split(b" ") if w]
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams))


def components(prints):
    """Smallest id reachable over links of three bits, by comparing all pairs."""
    label = {i: i for i in prints}
    while True:
        new = {i: min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("limit", [1 << 14, 3])
def test_near_duplicates(docs_of, limit):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("Abc dé f gh\x0bi jk".split(" ")) + str(rnd.randint(0, 30)) for _ in range(n))
    base = text(80).split()
    texts = [(i, text(rnd.choice([1, 2, 3, 30, 60]))) for i in range(30)] + [(30, None), (31, " \n "), (32, "One"), (33, "ONE")]
    for i in range(40, 75):  # a chain of small changes
        base[rnd.randrange(80)] = "new" + str(i)
        texts.append((i, " ".join(base)))
    got = simhash.near_duplicates(docs_of(texts + [(None, "one"), (40, texts[34][1])]), group_limit=limit).collect()
    want = {i: fingerprint(t) for i, t in texts}
    assert {r.doc_id: r.fp % (1 << 64) for r in got if r.doc_id is not None} == want
    assert {r.doc_id: r.component for r in got if r.doc_id is not None} == components(want)
    assert [r.component for r in got if r.doc_id is None] == [32] and len(got) == len(texts) + 2
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Repeated rows, and rows of one id with several texts, of which only one represents its component."""
    rnd = random.Random(11)
    one, two, other = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    rows = [(1, one, "a"), (5, one.upper(), "b"), (5, two, "c"), (5, two, "c"), (5, two, "d"), (7, two, "e"), (7, other, "f"), (9, other, "g"), (9, other, "g")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows * 2, "doc_id long, text string, source string").repartition(5))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(1, one), (5, two), (7, other)])
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {(r.doc_id, r.component) for r in found.collect()} == {(1, 1), (5, 1), (5, 5), (7, 5), (7, 7), (9, 7)}


def test_pipeline_with_repeated_rows(spark, tmp_path):
    """Stage 2 on rows that are repeated before it: later stages get each document once."""
    rnd = random.Random(12)
    rows = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))) for i in range(20)]
    spark.createDataFrame([*rows, *rows[:7], *rows[:3]], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    once = stage["near duplicates"](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(map(tuple, stage["repeats"](spark, once, str(tmp_path)).collect())) == rows


def test_rows_without_id(spark, tmp_path):
    """Near copies, chains, repeats and benchmark items without id are found; ids stay before rows without one."""
    rnd = random.Random(13)
    passage, other, item = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    step, prints, chain = 0, [], other.split()
    while len(prints) < 3:  # each near the one before; the first and the last are further apart
        text = " ".join(chain)
        if not prints or 0 < (fingerprint(text) ^ prints[-1][0]).bit_count() <= 3 and (len(prints) < 2 or (fingerprint(text) ^ prints[0][0]).bit_count() > 3):
            prints.append((fingerprint(text), text))
        chain, step = prints[-1][1].split(), step + 1
        chain[rnd.randrange(60)] = f"n{step}"
    rows = [(1, prints[0][1]), (None, prints[1][1]), (2, prints[2][1]), (None, passage), (None, passage.upper()), (None, passage)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, (r.component for r in found))) == ["1"] * 3 + ["None"] * 3
    left = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(left) == 2 and (1, prints[0][1]) in left and [r.text.lower() for r in left if r.doc_id is None] == [passage]
    rows = [(-7, "a" + passage), (9, "b"), (None, passage + item), (None, "c " + item)]
    cut = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(-7, "a" + passage), (9, "b")} < set(map(tuple, cut)) and sorted(r.doc_id is None for r in cut) == [False, False, True, True]
    assert sum(len(r.text) for r in cut) < len(passage) + len(item) + 10
    docs = spark.createDataFrame([(1, item), (2, passage)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, item), (4, "x y")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.remove_contaminated(docs, benchmark).collect()] == [2]
    hits = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in decontaminate.verdicts(decontaminate.search(docs, benchmark, nameless=True)).collect()}
    assert hits == {1: (60, [], True), 2: (0, [], False)}


def test_links_of_dense_groups():
    """Whole ranges linked at once, and pairs, give the components of all pairs."""
    rnd = random.Random(5)
    near = {rnd.getrandbits(64) for _ in range(40)}
    near |= {x ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(1, 3))) for x in list(near) for _ in range(5)} | set(range(64)) | {1 << k for k in range(64)}
    values = np.array(sorted(near), np.uint64)
    values = values[np.argsort(simhash.gray_rank(values))]
    edges = simhash.forest(values, np.array([0]), np.array([len(values)]))
    prints = {i: int(v) for i, v in enumerate(values)}
    parent = {i: i for i in prints}
    for a, b in edges:
        assert a != b
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    assert {i: root(i) for i in prints} == components(prints)
    assert len(edges) < len(values)


def test_gray_rank_is_the_order_of_the_gray_code():
    assert [int(x) for x in simhash.gray_rank(np.array([n ^ n >> 1 for n in range(64)], np.uint64))] == list(range(64))


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    plain = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(plain)] + [(2000 + i, plain[7].tolist(), "x") for i in range(700)]  # one vector has a third of the rows
    odd = [(5000, None, ""), (5020, [0.0] * 16, ""), (5040, [float("nan")] + [1.0] * 15, ""), (5060, [None] + [1.0] * 15, ""), (5080, [1.0] * 3, ""), (5100, [float("inf")] * 16, ""), (None, [1.0] * 16, "")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, tile string").repartition(7)
    got = defaultdict(list)
    for r in neighbours.nearest(table).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    vectors = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows}
    ids, matrix = np.array(list(vectors)), np.stack(list(vectors.values()))
    assert set(got) == {i for i in vectors if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        score = (matrix * vectors[q]).sum(axis=1)
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(vectors[q] @ vectors[i] - s) < 1e-9 for _, i, s in found)
        assert [f[1:] for f in found] == sorted([f[1:] for f in found], key=lambda f: (-f[1], f[0]))
        hit += len({f[1] for f in found} & set(ids[order].tolist()))
    assert hit / (20 * len(got)) >= 0.9
    few = neighbours.nearest(table.filter("vec_id < 6")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, k) for k in range(1, 6)]
    assert neighbours.nearest(table.limit(0)).count() == 0 and neighbours.nearest(table.filter("vec_id >= 5000")).count() == 0


def test_neighbours_with_repeated_ids(spark):
    """Rows of one near id, alike or not, take one place of a list."""
    one = [1.0, 2.0, 0.5, 1.0]
    rows = [(i, one) for i in range(1, 19)] + [(0, one)] * 3 + [(30, [2 * x for x in one])] * 40 + [(31, one)] * 25
    found = sorted((r.rank, r.vec_id) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("query_id = 0").collect())
    assert found == [(1, 30), *[(k + 1, k) for k in range(1, 19)], (20, 31)]
    rng = np.random.default_rng(3)
    near, query = rng.normal(size=(400, 8)), rng.normal(size=8)
    near[:200] += 2 * query  # many rows of few ids are nearest
    names = np.concatenate([rng.integers(0, 4, 200), rng.integers(0, 60, 200)])
    (ids,), (vectors,), starts = neighbours._by_id(names, near)
    best = {i: max(float((v * query).sum()) for k, v in zip(names.tolist(), near, strict=True) if k == i) for i in set(names.tolist()) - {2}}
    want = sorted(best, key=lambda i: (-best[i], i))[:20]
    got = neighbours._best(query, 2, ids, vectors, vectors @ query, 20, starts)
    assert got[0].tolist() == want and np.allclose(got[1], [best[i] for i in want])


def test_hilbert_is_a_path():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = np.argsort(neighbours.hilbert(cells, 3))
    assert sorted(neighbours.hilbert(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s> [\\\\INST] <\\/s>", None, "", "a [ROLE:", "[/ROLE] <s>\n</s>", "ends with [", "[INST"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate([("user", nasty[0]), ("assistant", nasty[1]), (None, nasty[2]), ("assistant", nasty[4]), ("user", nasty[7]), ("assistant", nasty[5])])]
    rows += [(2, 0, "system ] x", nasty[6]), (2, 1, "user", nasty[3]), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a"), (None, 0, "user", "x"), (None, None, "assistant", "y")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, position string").repartition(5)
    formatted = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(want)
    lengths = {r.conv_id: len(r.formatted) for r in formatted.collect()}
    for c, held in want.items():
        held.sort()
        loss = "".join(x for _, r, x in held if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256) == (len(held), digest("".join(f"{r}\n{x}\n" for _, r, x in held)))
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(loss), digest(loss), lengths[c])
    one = sorted(chat.with_context(formatted).filter("conv_id = 1").collect(), key=lambda r: r.example)
    whole = formatted.filter("conv_id = 1").first().formatted
    contexts = defaultdict(list)
    for r in chat.with_context(formatted).collect():
        contexts[r.conv_id].append(len(r.context))
    assert {c: (r.n_examples, r.context_chars) for c, r in got.items()} == {c: (len(contexts[c]), sum(contexts[c])) for c in got}
    assert [whole.startswith(r.context + r.target + " </s>") for r in one] == [True] * 3 and one[0].context.endswith("[/INST][ANS] ")
    assert chat.digests(chat.format_conversations(turns.limit(0))).count() == 0


INSULTS = ["grumblax", "snorfel", "wibbertosh"]


def insulting(seed, n, first=0):
    """Documents of invented words; every third one has insults, some of them with letters put in."""
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice("bcdefghklmnprstvw") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(first, first + n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 120))]
        toxic = i % 3 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        rows.append((i, ". ".join(" ".join(words[k : k + 8]) for k in range(0, len(words), 8))))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark, docs_of):
    rows, labels = insulting(1, 300)
    docs = docs_of([*rows, (900, None), (901, ""), (None, rows[0][1]), (0, rows[0][1])])
    marks = spark.createDataFrame([*labels, (5000, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, F.col("doc_id") % 4 != 2)
    scored = [(r.doc_id, r.score) for r in toxicity.scores(docs, model).collect()]
    assert len(scored) == 304 and all(0 <= s <= 1 for _, s in scored)
    held = [(s, d % 3 == 0) for d, s in scored if d is not None and d < 300 and d % 4 == 2]
    assert np.mean([(s >= 0.3) == t for s, t in held]) > 0.95
    score = lambda text: toxicity.scores(docs_of([(1, text)]), model).first().score
    calm = score("a calm day")
    assert score("you gruxmblax") > 10 * calm and score("you s n o r f e l") > 0.5 and score("you wibber-tosh") > 0.5
    kept = toxicity.keep_clean(docs, model, 0.3)
    assert kept.columns == docs.columns and {900, 901} <= {r.doc_id for r in kept.collect()}
    assert toxicity.fit(docs, marks.filter("toxic = 0"), F.lit(True)) is None
    assert [r.score for r in toxicity.scores(docs_of(rows[:2]), None).collect()] == [0.0, 0.0]
    assert toxicity.scores(docs_of([]), model).count() == 0


def test_toxicity_learns_from_what_is_there(spark, docs_of):
    """Labels of absent, empty and repeated documents do not use up the sample, and long documents are read."""
    rows, labels = insulting(4, 240)
    calm = ". ".join(f"pa{k}lo mi{k % 37}ne" for k in range(2500))
    first = min((i for i, y in labels if y), key=lambda i: toxicity.xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42))  # the first by hash
    docs = docs_of([*rows, *[(i, "") for i in range(1000, 1400)], *[(first, rows[first][1])] * 300])
    marks = spark.createDataFrame([*labels, *[(i, i % 2) for i in range(1000, 9000)]], "doc_id long, toxic int")
    held, bad = insulting(5, 120)
    right = lambda model: np.mean([(r.score >= 0.3) == (r.doc_id % 3 == 0) for r in toxicity.scores(docs_of(held), model).collect()])
    assert right(toxicity.fit(docs, marks, F.lit(True), sample=80)) > 0.9
    long = [(i, t + ". " + calm + ". " + t if y else t) for (i, t), (_, y) in zip(rows, labels, strict=True)]
    assert min(len(t) for (_, t), (_, y) in zip(long, labels, strict=True) if y) > 20_000
    assert toxicity.fit(docs_of(long), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)) is not None
    text = ("abc " * 50 + ". ").encode() + b"x" * 100_000 + b" " + b". ".join(b"d%d e" % k for k in range(9000)) + b". snorfel"
    cut = toxicity.sentences(toxicity.excerpt(text))
    assert 10_000 < sum(len(w) for x in cut for w in x) + 1 <= 20_000 and cut == toxicity.sentences(toxicity.excerpt(text))
    assert toxicity.excerpt("é".encode() * 20_000) == "é".encode() * 20_000


def test_kernel_by_enumeration():
    from itertools import combinations

    def plain(s, t, decay):
        total = 0.0
        for a in combinations(range(len(s)), 3):
            for b in combinations(range(len(t)), 3):
                if [s[i] for i in a] == [t[i] for i in b]:
                    total += decay ** (a[2] - a[0] + 1 + b[2] - b[0] + 1)
        return total

    words = [b"idiot", b"idxiot", b"tidiot", b"aaa", b"ab", b"banana"]
    pairs = [(s, t) for s in words for t in words]
    got = toxicity.kernel(toxicity._codes([s for s, _ in pairs], 8), toxicity._codes([t for _, t in pairs], 8), 0.55)
    assert np.allclose(got, [plain(s, t, 0.55) for s, t in pairs], rtol=1e-4)


def test_gradients():
    rng = np.random.default_rng(0)
    draw = lambda *shape: rng.normal(0, 0.5, shape)
    net = languages.Network(["a", "b"], [draw(256, 9) for _ in (0, 1)], [draw(3, 9) for _ in (0, 1)], draw(6, 2), draw(2))
    data, mask, target = rng.integers(97, 100, (5, 4)).astype(np.uint8), np.ones((5, 4)), np.array([0, 1, 1, 0])
    mask[3:, 1] = 0

    def loss():
        p = languages.label(data, net)[:, target, np.arange(4)]
        return -(np.log(p) * mask).sum() / mask.sum()

    for part, gradient in zip(languages._parts(net), languages._gradients(data, mask, target, net), strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) if n < 256 else rng.integers(97, 100) for n in part.shape)
            kept = part[at]
            part[at] = kept + 1e-4
            up = loss()
            part[at] = kept - 1e-4
            down = loss()
            part[at] = kept
            assert abs((up - down) / 2e-4 - gradient[at]) < 1e-3


def test_languages(spark):
    rnd = random.Random(2)
    sounds = {"xx": ["ka", "to", "mi"], "yy": ["sch", "ung", "er"]}
    rows = [(i, "".join(rnd.choice(sounds[lang]) + " " * (rnd.random() < 0.3) for _ in range(rnd.randint(5, 200))), lang) for i in range(120) for lang in [["xx", "yy"][i % 2]]]
    odd = [(200, None, "xx"), (201, " 12 !", "yy"), (202, "ka to", None), (None, "ka to mi", "xx"), (0, rows[0][1], "xx"), (203, "½ ² ① Ⅷ", "xx")]
    docs = spark.createDataFrame([(*r, "k") for r in rows + odd], "doc_id long, text string, lang string, key string")
    net = languages.fit(docs, F.col("doc_id") % 3 != 1)
    assert net.names == ["xx", "yy"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in languages.predict(docs, net).collect()]
    assert len(got) == 126 and all(0 <= s <= 1 for *_, s in got)
    assert np.mean([p == ["xx", "yy"][d % 2] for d, p, _ in got if d is not None and d < 120 and d % 3 == 1]) > 0.95
    assert {d: p for d, p, _ in got if d in (200, 201, 203)} == dict.fromkeys((200, 201, 203), "und")
    assert languages.fit(docs.filter("lang IS NULL"), F.lit(True)) is None
    assert {r.lang_pred for r in languages.predict(docs, None).collect()} == {"und"}
    assert languages.predict(docs.limit(0), net).count() == 0


def test_languages_of_long_and_repeated_documents(spark, monkeypatch):
    """A language of long documents only is learned, and the copies of one document do not fill the sample."""
    rnd = random.Random(6)
    sounds = {"xx": ["ka", "to", "mi"], "yy": ["sch", "ung", "er"]}
    text = lambda lang, n: "".join(rnd.choice(sounds[lang]) + " " * (rnd.random() < 0.3) for _ in range(n))
    rows = [(i, text("xx", 50), "xx") for i in range(40)] + [(100 + i, text("yy", 12_000), "yy") for i in range(20)]
    rows += [(3, rows[3][1], "xx")] * 500 + [(5, text("xx", 40), "xx") for _ in range(60)] + [(None, "ka to", "xx")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(t) for _, t, lang in rows if lang == "yy") > 20_000
    seen = []
    monkeypatch.setattr(languages, "train", lambda examples: seen.append(examples))
    languages.fit(docs, F.lit(True), sample=30)
    monkeypatch.undo()
    assert {lang for _, lang in seen[0]} == {"xx", "yy"}
    texts = {t.encode()[: languages.SEGMENT] for _, t, lang in rows if lang == "xx"}
    assert len(texts & {t for t, _ in seen[0]}) == 30 and len(seen[0]) <= 60 * languages.PER_DOC
    ends = {t.encode()[-languages.SEGMENT :] for _, t, lang in rows if lang == "yy"}
    assert ends <= {t for t, _ in seen[0]}
    net = languages.fit(docs, F.lit(True))
    assert {r.doc_id: r.lang_pred for r in languages.predict(docs.filter("doc_id >= 100"), net).collect()} == {100 + i: "yy" for i in range(20)}


def test_pipeline(spark, tmp_path):
    """Every stage against its rule on its own input; planted cases go, clean documents stay."""
    rows, labels = insulting(3, 240)
    rnd = random.Random(8)
    words = lambda n: " ".join("".join(rnd.choice("bdgklmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(n))
    long, item = words(200), words(30)
    rows += [(300, long), (301, long), (302, words(60) + " " + long[:700] + " " + words(60)), (303, item + " " + words(40)), (304, words(80)), (305, None), (306, "")]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(docs)
    assert [d.columns for d in seen[:4]] == [[c.split()[0] for c in names.split(", ")]] * 4
    at = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in seen[:4]]
    toxic = {i for i, y in labels if y}
    assert len(toxic & set(at[0])) <= 2 and len(at[0]) >= len(rows) - len(toxic) - 4 and set(range(300, 307)) <= set(at[0])
    want = components({i: fingerprint(t) for i, t in at[0].items()})
    assert set(at[1]) == {i for i, c in want.items() if i == c} and 301 not in at[1]
    assert set(at[2]) == set(at[1]) and long[10:690] not in at[2][302] and at[2][300] == long and at[2][304] == at[1][304]
    assert set(at[3]) == set(at[2]) - {303}
    assert {r.doc_id for r in seen[4].collect()} == set(at[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()
