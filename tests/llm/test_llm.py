"""The operators on texts against brute force and round trips."""

import math
import os
import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest

from graphloom.llm.leak import candidates, leaks
from graphloom.llm.mixing import Mixture, token_sizes
from graphloom.llm.spam import CLASSES, Reader, page_scores, spam_pages, verdicts
from graphloom.llm.spans import shared_spans

TEXT = "id long, text string, h long, tid long, source string"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, (s[0] if s else None)) for i, t, *s in rows], TEXT)


def brute_spans(rows, n):
    own = {}
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            own.setdefault(t[k : k + n], set()).add(i)
    out = {}
    for i, t in rows:
        on = set()
        for k in range(len(t or "") - n + 1):
            if len(own[t[k : k + n]]) > 1:
                on.update(range(k, k + n))
        if on:
            out[i] = len(on)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_shared_spans(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé𝄞 ;(") for _ in range(rnd.randint(1, 30)))
    parts = ["".join(word() for _ in range(rnd.randint(1, 12))) for _ in range(12)] + ["a" * 300, "ab" * 90, "x" * 79, "y" * 80]
    rows = [(i, "".join(rnd.choice(parts) if rnd.random() < 0.4 else word() for _ in range(rnd.randint(0, 9)))) for i in range(120)]
    rows += [(None, parts[1] * 2), (500, None), (501, ""), (502, rows[3][1]), (503, parts[0] * 3), (504, parts[-1]), (505, parts[-1]), (506, "q" * 200)]
    got = {r.id: r.shared_chars for r in shared_spans(texts(spark, rows + rows[:9])).collect()}
    assert got == brute_spans([r for r in rows if r[0] is not None], 80)


def test_shared_spans_edges(spark):
    assert shared_spans(texts(spark, [])).count() == 0
    assert shared_spans(texts(spark, [(1, "ab" * 100), (2, None)])).count() == 0
    rows = [(1, "z" * 30 + "common text here" * 3), (2, "common text here" * 3), (3, "short")]
    assert {r.id: r.shared_chars for r in shared_spans(texts(spark, rows), min_span=20).collect()} == brute_spans(rows, 20)


def test_shared_spans_of_like_sums(spark):
    """A long text of two letters and its mirror image, whose sums modulo 2^64 agree, are different texts."""
    flip = str.maketrans("ab", "ba")
    text = "a"
    while len(text) < 2048:
        text += text.translate(flip)
    mirror = text.translate(flip)
    rows = [(1, "x1" + text), (2, "y2" + mirror), (3, "z3" + mirror[:1000])]
    assert {r.id: r.shared_chars for r in shared_spans(texts(spark, rows)).collect()} == brute_spans(rows, 80)


def brute_leaks(docs, items, n):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda t: {tuple(w[i : i + n]) for w in [words(t)] for i in range(len(w) - n + 1)}
    return {(i, d, len(grams(a) & grams(b))) for i, a in items for d, b in docs if grams(a) & grams(b)}


@pytest.mark.parametrize("map_bits", [24, 8])
def test_leaks(spark, map_bits, monkeypatch):
    monkeypatch.setattr("graphloom.llm.leak.MAP_BITS", map_bits)
    rnd = random.Random(map_bits)
    vocab = ["Ärger", "naïve", "x1", "the", "a", "Ω", "zwölf", "b"]
    text = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", ",", " -", "\n"]) for _ in range(n))
    items = [(i, text(rnd.randint(3, 40))) for i in range(12)] + [(50, None), (51, "")]
    items.append((52, items[2][1]))
    cut = lambda t: " ".join((t or "").split()[rnd.randint(0, 5) :][:20])
    docs = [(i, text(30) + " " + (cut(rnd.choice(items)[1]).upper() if rnd.random() < 0.6 else "") + " " + text(20)) for i in range(60)] + [(100, None), (101, "   ")]
    got = {(r.item_id, r.doc_id, r.n_windows) for r in leaks(texts(spark, docs + docs[:5] + [(None, items[0][1])]), texts(spark, items + items[:2] + [(None, items[0][1])])).collect()}
    assert got == brute_leaks(docs, items, 13) and got


def test_leaks_long(spark):
    """Windows across the stretches of a leaked text of many words, and a text of one word over and over."""
    rnd = random.Random(5)
    text = " ".join(f"w{rnd.randint(0, 400)}" for _ in range(700))
    part = " ".join(text.split()[100:400])
    docs, items = [(1, text + " x"), (2, "y " + part), (3, "z " * 90), (4, text[:200])], [(7, part), (8, "z " * 40), (9, text.upper())]
    got = {(r.item_id, r.doc_id, r.n_windows) for r in leaks(texts(spark, docs * 2), texts(spark, items)).collect()}
    assert got == brute_leaks(docs, items, 13) and len(got) == 6


def test_leaks_prefix_is_necessary(spark):
    """The prefix brings fewer places together than all shingles do, and loses no case."""
    rnd = random.Random(6)
    vocab = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(30))) for i in range(5)]
    docs = [(i, " ".join(items[i % 5][1].split()[rnd.randint(0, 9) :]) + " " + " ".join(rnd.choice(vocab) for _ in range(20))) for i in range(30)]
    few, many = (candidates(texts(spark, docs), texts(spark, items), prefix=p)[0] for p in (True, False))
    assert 0 < few.count() < many.count() / 2 and few.exceptAll(many).count() == 0


def test_leaks_empty(spark):
    some = texts(spark, [(1, "a " * 50)])
    assert leaks(some, texts(spark, [])).count() == 0 and leaks(texts(spark, []), some).count() == 0
    assert {(r.item_id, r.doc_id) for r in leaks(some, some).collect()} == {(1, 1)}


def mixed(spark, docs, targets):
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return Mixture(texts(spark, docs), t, seed=3)


def test_mixture(spark):
    docs = [(i, "word " * (5 + i % 40), ("Big " if i % 2 else "big") if i < 900 else "small") for i in range(1000)] + [(2000, None, "big"), (2001, "  ", "big"), (2002, "word", None), (None, "word", "big"), (2003, "other " * 500, "other")]
    m = mixed(spark, docs + docs[:20], [("big", 0.5, 3), ("small", 0.5, 2), ("none", 0.1, 9), ("big", 0.5, 3)])
    shares = {r.source: r for r in m.shares.collect()}
    size = {r.id: r.n_tokens for r in token_sizes(texts(spark, docs)).collect()}
    total = sum(size.values())
    assert set(shares) == {"big", "small", "none"} and shares["none"].drawn_tokens == 0
    big = shares["big"]
    assert abs(big.drawn_tokens - 0.5 * total) <= 0.01 * total and not big.capped and big.most_copies <= 2
    small = shares["small"]
    assert small.capped and small.drawn_tokens == 2 * small.tokens and small.most_copies == 2
    drawn = m.drawn.collect()
    assert len({r.doc_id for r in drawn}) == len(drawn) and not {2000, 2001, 2002, 2003} & {r.doc_id for r in drawn}
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, mixed(spark, docs, [("big", 0.5, 3), ("small", 0.5, 2), ("none", 0.1, 9)]).drawn.collect()))
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    assert {(r.within_largest, r.repeats_kept) for r in m.kept.collect()} == {(1, 1)}
    # copies of a document differ by at most one within a source
    assert {r.copies for r in drawn if r.source == "big"} <= {1, 2}


def test_mixture_empty(spark):
    m = mixed(spark, [], [("big", 1.0, 3)])
    assert m.drawn.count() == 0 and m.shares.first().drawn_tokens == 0
    assert mixed(spark, [(1, "word", "big")], [(None, 1.0, 3)]).shares.count() == 0


PROSE = ["The script writes to the field before the layout is shown to the user.", "When the list is empty, it will not sort at all for the team.", "Deleting one of the rows also deletes what is in the other table.", "Das Skript schreibt in die Tabelle, bevor das Layout zu sehen ist.", "We keep a copy of the data so that it can be built again by the server."]


def pages(seed=2):
    rnd = random.Random(seed)
    prose = lambda n: " ".join(rnd.choice(PROSE) for _ in range(n))
    keys = ["cheap viewer", "best plugin", "gratis crm tool"]
    ok = [(i, prose(rnd.randint(3, 9))) for i in range(60)]
    steps = "\n".join(["Set Field [ a_b::c_d ; 1 ]", "Perform Script", "Go to Layout", "Set Variable"] * 8)
    ok += [(100 + i, prose(1) + "\n" + steps) for i in range(5)]
    ok += [(110, prose(6) + "\nReferences:\n- https://a.example/b\n- https://c.example/d"), (111, prose(6) + "\nTags: cheap viewer, best plugin"), (112, "Thanks!"), (113, None), (114, " "), (None, "cheap viewer, " * 50), (115, "2025-01-02 10:00 Close Ledger error 401 in a_b::c\n" * 9)]
    spam = [(200, ", ".join(rnd.choice(keys) for _ in range(60))), (201, "\n".join(f"https://{i}.example/x" for i in range(20))), (202, " ".join(f"#tag{i}" for i in range(40))), (203, "\n".join(f"Best Plugin | AB-{i} | {i}.99 | sale" for i in range(20)))]
    spam += [(204, prose(1) + "\n" + "\n".join(rnd.choice(keys) for _ in range(60))), (205, "<p>" + "<br>".join(f"[cheap viewer](http://{i}.example/)" for i in range(20)) + "</p>"), (206, " ".join(rnd.choice("quiba kiln loom parcel hosting".split()) for _ in range(90)).upper())]
    return ok, spam


def judged(spark, rows):
    """Labels (id, rater, verdict) of pages given as (id, is spam)."""
    return spark.createDataFrame([(i, r, "spam" if bad else "ok") for i, bad in rows for r in ("a", "b")], "id long, rater string, verdict string")


def test_spam(spark):
    """Trained on one half of the pages, asked for the other."""
    ok, spam = pages()
    more_ok, more_spam = pages(11)
    labels = judged(spark, [(i + 5000, False) for i, _ in more_ok if i] + [(i + 5000, True) for i, _ in more_spam])
    labels = labels.unionByName(labels).unionByName(spark.createDataFrame([(5200, "c", "ok"), (5200, "c", "unsure"), (None, "c", "spam"), (5001, "c", None)], labels.schema))
    rows = ok + spam + spam[:2] + [(i + 5000, t) for i, t in more_ok + more_spam if i]
    got = {r.id for r in spam_pages(texts(spark, rows), labels).collect()}
    assert {i for i in got if i < 5000} == {i for i, _ in spam}
    none = judged(spark, [])
    assert spam_pages(texts(spark, []), labels).count() == 0 and page_scores(texts(spark, [(1, None), (2, "")]), labels).count() == 0
    assert spam_pages(texts(spark, rows), none).count() == 0
    long_ = {r.id: r for r in page_scores(texts(spark, rows + [(900, "cheap viewer, " * 100_000)]), labels).collect()}
    assert long_[900].stuffed_chars > 0.6 * long_[900].n_chars


def test_spam_in_a_third_of_the_rows(spark):
    ok, spam = pages()
    copies = [(1000 + i, "free database zowexsut\n" * 40) for i in range(len(ok) // 2)]
    labels = judged(spark, [(i, False) for i, _ in ok[:40]] + [(i, True) for i, _ in spam] + [(1000, True), (1001, True)])
    assert {i for i, _ in copies} <= {r.id for r in spam_pages(texts(spark, ok + spam + copies), labels).collect()}


def test_spam_scores_by_hand(spark):
    """Bits and stuffed characters as a plain calculation from counts gives them."""
    rows = [(1, "The cat is on the mat and it is not on the bed."), (2, "cheap viewer, cheap viewer, cheap viewer, cheap viewer"), (3, "cheap viewer\nThe dog is in the bed and it is not on the mat.")]
    labels = judged(spark, [(1, False), (2, True)])
    reader, seqs = Reader(4), {}
    for i, t in rows:
        seqs[i] = [line + b"\0" for line in reader.page(t)[0].split(b"\0")[:-1]]
    grams = lambda line: [((line[k - 2] if k > 1 else 0), (line[k - 1] if k else 0), line[k]) for k in range(len(line))]
    every = [line for own in seqs.values() for line in own]
    sentences = [line for line in every if line[-2] == CLASSES.index(".")]
    single = Counter(x for line in every for x in line)
    base = {c: (single[c] + 0.5) / (sum(single.values()) + 0.5 * len(CLASSES)) for c in range(len(CLASSES))}

    def bits(lines, line, w=30.0):
        g3, g2, g1 = Counter(), Counter(), Counter()
        for x in lines:
            for a, b, c in grams(x):
                g3[a, b, c] += 1
                g2[b, c] += 1
                g1[c] += 1
        out = 0.0
        for a, b, c in grams(line):
            p1 = (g1[c] + w * base[c]) / (sum(g1.values()) + w)
            p2 = (g2[b, c] + w * p1) / (sum(n for (x, _), n in g2.items() if x == b) + w)
            out -= math.log2((g3[a, b, c] + w * p2) / (sum(n for (x, y, _), n in g3.items() if (x, y) == (a, b)) + w))
        return out

    for r in page_scores(texts(spark, rows), labels).collect():
        lines = [x for x in re.split("\n", dict(rows)[r.id])]
        stuffed = sum(len(t) for t, x in zip(lines, seqs[r.id]) if bits(seqs[2], x) < min(bits(sentences, x), bits(seqs[1], x)))
        assert (r.n_chars, r.stuffed_chars) == (sum(map(len, lines)), stuffed)
        assert r.bits == pytest.approx(sum(bits(sentences, x) for x in seqs[r.id]) / sum(map(len, seqs[r.id])))


def test_reader():
    seq, chars = Reader(2).page("One two two.\r\nThree <br> four [x](http://a.example/b c)")
    assert seq.count(b"\0") == len(chars) and chars[0] == len("One two two.")
    link = CLASSES.index("<link>")
    assert Reader(2).page("[" + "long anchor " * 60 + "](https://a.example/b)")[0] == bytes([link, 0]) and Reader(2).page("<a href='x'>here</a>")[0] == bytes([link, 0])
    began = time.time()
    for x in ("[", "<a>", "<p ", "# ", "(", "a_"):
        Reader(2).page(x * 100_000)
    assert time.time() - began < 60


def test_labels(spark):
    """Held-out accuracy: fitted to half of the judged pages, the flags agree with the raters' clear verdicts on the other half, of which some are wrong."""
    base = "/root/testdata/sf0.1"
    if not os.path.isdir(base):
        pytest.skip("no test data here")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet").selectExpr("doc_id as id", "text"), spark.read.parquet(f"{base}/page_labels.parquet").withColumnRenamed("doc_id", "id")
    found = {r.id for r in spam_pages(docs, labels.where("pmod(xxhash64(id), 2) = 0")).collect()}
    clear = {r.id: r.spam for r in verdicts(labels.where("pmod(xxhash64(id), 2) = 1"), 10_000).collect()}
    hit = sum(i in found for i, bad in clear.items() if bad)
    wrong = sum(i in found for i, bad in clear.items() if not bad)
    assert hit >= 0.8 * sum(clear.values()) and wrong <= 0.05 * (len(clear) - sum(clear.values())), (hit, wrong, sum(clear.values()), len(clear))
