"""Packing, decontamination, licences, token counts and suffixes against plain versions on small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from rankloom.llm import counting, decontaminate, licenses, packing, suffixes
from rankloom.llm.tokens import ByteBpe

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def mixed_texts(seed, n, alphabet, most):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, most))) for _ in range(n)]


ODD = ["", " ", "  ", "a ", "a\n b", "a\n  b", "a \n b", "a\n \nb", "it's 's  'll ''s", "<|endoftext|> x<|startoftext|>", "日本 x", "é \xa0 x\xa0", "\x85 \x85", "İΣΑΣ ½ 12³", "a" * 3000, "thing" * 700 + " the" * 50]


@pytest.mark.parametrize("part", [1, 7, 1 << 20])
def test_texts_get_the_library_ids(part):
    library, ours = Tokenizer.from_file(path("byte_bpe_50k.json")), ByteBpe(path("byte_bpe_50k.json"), part)
    texts = ODD + mixed_texts(2, 400, "ab1'.,  \n\té\xa0s ²ª", 40)
    for k in range(0, len(texts), 37):
        some = texts[k : k + 37]
        assert ours.encode(some) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]


def test_a_text_above_a_megabyte_gets_the_library_ids():
    library, ours = Tokenizer.from_file(path("byte_bpe_50k.json")), ByteBpe(path("byte_bpe_50k.json"))
    text = " ".join(mixed_texts(7, 40, "abcdeist ", 60000))
    assert len(text) > 1 << 20
    assert ours.encode([text, "x"])[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_transducer_counts_as_the_library(monkeypatch):
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = ODD + mixed_texts(1, 300, "abcdehilnorstu'  .,!0é", 300) + mixed_texts(3, 100, "aZé中́😀ß '9-\t", 80)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    counter = counting.Counter(path("word_bpe_49k.json"))
    assert counter.count(list(texts)).tolist() == want
    monkeypatch.setattr(counting, "CHUNK", 3)  # nearly every chunk begins inside a word
    monkeypatch.setattr(counting, "CELLS", 1)  # and the machine starts over
    assert counter.count(list(texts)).tolist() == want


def test_long_texts_are_cut_at_blanks():
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    counter = counting.Counter(path("word_bpe_49k.json"))
    for text in [*mixed_texts(5, 40, "ab c'st  .é\u0301\n", 200), "x" * 50, "<|endoftext|> " * 9]:
        for size in (1, 7, 50):
            parts = list(counting.cut_at_blanks(text, size))
            assert "".join(parts) == text
            assert sum(int(counter.count([p])[0]) for p in parts) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts_rows(docs_of, spark):
    rows = {r.doc_id: r for r in counting.token_counts(docs_of([(1, None), (2, ""), (3, "the cat"), (None, "cat")]), path("word_bpe_49k.json"), limit=1).collect()}
    assert (rows[1].n_tokens, rows[2].n_bytes, rows[3].n_tokens, rows[3].over_limit, rows[None].over_limit) == (0, 0, 2, True, False)
    assert counting.token_counts(docs_of([]), path("word_bpe_49k.json")).count() == 0


def test_packing(docs_of):
    rnd = random.Random(4)
    texts = [(i, " ".join(rnd.choice(["one", "two", "three"]) for _ in range(rnd.choice([0, 1, 5, 30, 60, 300])))) for i in range(150)]
    texts += [(150, None), (3, texts[3][1]), (None, "no id"), (None, "no id")]
    docs, capacity = docs_of(texts), 64
    got = packing.pack(packing.pieces(docs, path("byte_bpe_50k.json"), capacity, with_ids=True), capacity)
    rows = got.collect()
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k in range(len(cuts) - 1):
            part = ids[cuts[k] : cuts[k + 1]]
            want[i, k, cuts[k], len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    have = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    tokens = sum(r.length for r in rows)
    assert len(bins) <= 1.1 * tokens / capacity + 1
    whole = packing.sequences(got).collect()
    assert sum(len(r.ids) for r in whole) == tokens and max(len(r.ids) for r in whole) <= capacity
    assert packing.pack(packing.pieces(docs_of([]), path("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_each_length_once(seed):
    rnd = random.Random(seed)
    capacity = 60
    counts = {n: rnd.choice([0, 1, 2, 7, 40]) for n in range(1, capacity + 1)}
    left = dict.fromkeys(counts, 0)
    for pattern, times in packing.plan(counts, capacity):
        assert sum(pattern) <= capacity and times > 0
        assert sum(3 * n > capacity for n in pattern) <= 2
        for n in pattern:
            left[n] += times
    assert left == counts


def contaminated_by_brute_force(texts, items, window):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(fold(t))
        for k in range(max(1, len(w) - window + 1)):
            if i is not None and w[k : k + window]:
                windows[tuple(w[k : k + window])].add(str(i))
    out = []
    for i, t in texts:
        w, hit, names = WORD.findall(fold(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= found
        out.append((i, len(w), len(hit), tuple(sorted(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, docs_of, block_bytes):
    rnd = random.Random(8)
    words = ["al", "Be", "été", "x1", "gamma", "d", "longerword"]
    phrase = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, phrase(rnd.choice([1, 2, 5, 6, 20]))) for i in range(12)] + [(12, None), (13, ""), (None, "al Be"), (14, "—d, D!")]
    items += [(15, items[3][1])]
    texts = [(i, phrase(rnd.choice([0, 3, 40, 400]))) for i in range(30)] + [(30, None), (31, items[4][1].upper()), (31, items[4][1]), (None, items[5][1])]
    texts += [(40, phrase(5000) + " ; " + items[6][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(texts)
    found = decontaminate.verdicts(decontaminate.search(docs, benchmark, window=5, block_bytes=block_bytes)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found), key=str)
    assert got == contaminated_by_brute_force(texts, items, 5)
    kept = decontaminate.remove_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert decontaminate.verdicts(decontaminate.search(docs, benchmark.limit(0))).filter("n_hit > 0").count() == 0
    assert decontaminate.search(docs_of([]), benchmark).count() == 0


def test_licences(docs_of):
    filler = "lorem ipsum dolor " * 5
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    texts = [
        (1, "CC BY, cc-by; General Public License. all rights reserved all RIGHTS reserved"), (2, None), (3, "cc"), (4, filler),
        (5, filler + mit + filler), (6, mit.replace("free of charge,", "entirely free of any charge")), (7, "general public general public license"),
        (8, "rights reserved all"), (1, "CC BY, cc-by; General Public License. all rights reserved all RIGHTS reserved"), (None, "cc by"),
    ]
    got = {(r.doc, r.n_words): r for r in licenses.scan(docs_of(texts)).collect()}
    assert len(got) == 9 and licenses.scan(docs_of(texts)).filter("doc = 1").count() == 2  # rows that repeat are answered each
    one = got[1, 13]
    assert (one.n_base, one.first_word, one.last_word, one.base_labels) == (5, 0, 10, "cc-by,gpl,reserved")
    assert (got[2, 0].n_base, got[2, 0].first_word, got[2, 0].labels, got[2, 0].score) == (0, None, "", 0.0)
    assert got[4, 15].labels == "" and got[3, 1].n_words == 1
    assert [r.labels for (d, _), r in got.items() if d == 5] == ["mit-grant"] and [r.labels for (d, _), r in got.items() if d == 6] == ["mit-grant"]
    seven = [r for (d, _), r in got.items() if d == 7][0]
    assert (seven.n_base, seven.first_word, seven.base_labels) == (1, 2, "gpl")
    assert [r.n_base for (d, _), r in got.items() if d in (8, None)] in ([0, 1], [1, 0])
    assert licenses.scan(docs_of([])).count() == 0


def test_licences_by_brute_force(docs_of):
    """Base places of random word sequences, and a text above a megabyte in time that grows with its words."""
    rnd = random.Random(14)
    words = ["cc", "by", "CC", "general", "public", "license", "all", "rights", "reserved", "x", "é"]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 30, 200])))) for i in range(60)]
    texts += [(60, " ".join(rnd.choice(words) for _ in range(250_000))), (5, texts[5][1]), (None, texts[6][1])]
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

    def base(text):
        w = WORD.findall(fold(text))
        found = [(k, name) for p, name in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.encode().split()]
        places = [k for k, _ in found]
        return (len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({name for _, name in found})))

    got = [(r.doc, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs_of(texts)).collect()]
    assert sorted(got, key=str) == sorted(((i, *base(t)) for i, t in texts), key=str)


def without_repeats_by_brute_force(texts, length=100):
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in texts):
        cover = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            part = t[k : k + length]
            if part in seen:
                cover[k] += 1
                cover[k + length] -= 1
            seen.add(part)
        gone = np.cumsum(cover)[: len(t)] > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffixes(docs_of, monkeypatch):
    rnd = random.Random(6)
    make = lambda n: "".join(rnd.choice("ab é") for _ in range(n))
    passage = make(400)
    texts = [(i, make(rnd.randint(0, 150)) + passage[rnd.randint(0, 80) : rnd.randint(150, 400)] + make(rnd.randint(0, 150))) for i in range(40)]
    texts += [(50, None), (51, ""), (52, "a" * 1500), (53, "xy" * 400), (54, passage * 4), (-5, passage[100:300]), (55, texts[0][1]), (56, "x" * 99)]
    want = without_repeats_by_brute_force(texts)
    docs = docs_of(texts + [(None, passage)])
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffixes.remove_repeats(docs).collect()}
    assert got.pop(None)[1:3] == (0, 0)
    assert got == want
    cut = suffixes.without_repeats(docs)
    assert cut.columns == docs.columns
    texts_left = {r.doc_id: r.text for r in cut.collect()}
    assert texts_left[50] is None and texts_left[51] == "" and texts_left[55] == ""
    twice = suffixes.remove_repeats(docs_of(texts[:5] + texts[:5])).collect()  # repeated rows are one document
    assert {r.doc: r.n_removed for r in twice} == {i: without_repeats_by_brute_force(texts[:5])[i][1] for i, _ in texts[:5]} and len(twice) == 10
    assert suffixes.remove_repeats(docs_of([])).count() == 0


def test_texts_under_one_id_are_apart(docs_of):
    """Different texts of one id, many of which end in the same bits, lose only what they repeat themselves."""
    rnd = random.Random(10)
    make = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, own = make(300), [make(500) for _ in range(400)]
    texts = [(1, passage), *[(2, t) for t in own], (2, make(50) + passage + make(50)), (2, own[0]), (3, own[7][100:350])]
    got = [(r.doc, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(docs_of(texts).repartition(7)).collect()]
    want = [(1, 300, 0, 0), *[(2, 500, 0, 0)] * 401, (2, 400, 300, 1), (3, 250, 250, 1)]
    assert sorted(got) == sorted(want)
    small = {variant for variant in suffixes.numbered_texts(docs_of(texts).selectExpr("doc_id AS doc", "text")).filter("doc = 2").toPandas()["variant"]}
    assert small == set(range(401))


def test_suffix_parts_and_batches(monkeypatch):
    """Cutting documents into small parts and sending small batches changes nothing."""
    rnd = random.Random(9)
    text = ("".join(rnd.choice("abcd ") for _ in range(700)) + "hello world " * 30 + "".join(rnd.choice("ab") for _ in range(300))).encode()
    for size in (1 << 18, 97, 260):
        monkeypatch.setattr(suffixes, "PART", size)
        covered = []
        for at, first, count, _, _ in suffixes._runs(text, 100):
            covered += [at + f + k for f, c in zip(first.tolist(), count.tolist(), strict=True) for k in range(c)]
        assert covered == list(range(len(text) - 99))
