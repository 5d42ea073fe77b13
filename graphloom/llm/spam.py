"""Keyword-stuffed and link-list pages: n-gram perplexity of function-word and word-class sequences, line by line."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import Stages, map_batches

# Common function words of English, German, French and Spanish, kept as they are in the sequences.
FUNCTION_WORDS = frozenset(
    """
a an and are as at be because been before but by for from had has have if in into is it its no not of on one or our so that the their them then
they this to was we were when where which while who will with you
aber als am auf aus bei bevor das dass dem den der des die durch ein eine einem einen einer es für hat im ist mit nach nicht noch nur oder sich sie sind
um und uns von vor wenn wie wir wird zu zum zur
au aux avant ce ces cette chaque dans de du elle en est et il la le les leur mais ne nous où par pas pour que qui sa sans ses son soit sur une
al antes como con cuando del desde el entre esta este hay las lo los más nadie para pero por qué se sin su sus un una y
""".split()
)

_TOKEN = re.compile(
    r"(?P<link>\[[^\[\]\n]*\]\([^()\s]{3,}\)|<a\b[^<>]*>(?:[^<]*</a>)?|(?:https?://|www\.)[^\s<>()\[\]]+)"
    r"|(?P<tag>\#[^\W_][\w-]*)"
    r"|(?P<price>(?:[$€£]\s?)?\d+[.,]\d\d(?![\d.,]))"
    r"|(?P<sku>\b[A-Z]{2,}-\d+\b)"
    r"|(?P<ident>\$*~?\w*::\w+|\$*[^\W\d]\w*_\w+|\$+\w+|~\w+)"
    r"|(?P<num>-?\d[\d.,:%/-]*)"
    r"|(?P<word>[^\W\d_]+(?:[-'’][^\W\d_]+)*)"
    r"|(?P<punct>[^\w\s])"
)
_BREAK = re.compile(r"\r\n|[\r\n]|<br\s*/?>|</?(?:p|div|li|ul|ol|h\d|tr|table)\b[^<>]*>", re.I)
_STOP = re.compile(r"(?<=[.!?])\s+(?=\S)")
_SPACED = re.compile(r"\]\(|<a\b|[$€£]\s")

# The classes of a sequence, each a byte: end of line, function words, other words by case (repeated or not), signs, the rest.
_SHAPES = ["Lower", "Title", "Upper", "LowerAgain", "TitleAgain", "UpperAgain"]
_SIGNS = list(".,;:!?|·-–*/>'") + ["code sign", "sign"]
_KINDS = ["<link>", "<tag>", "<price>", "<sku>", "<ident>", "<num>"]
CLASSES = ["<end>", *sorted(FUNCTION_WORDS), *_SHAPES, *_SIGNS, *_KINDS]
_ID = {c: i for i, c in enumerate(CLASSES)}
_CODE = frozenset("()[]{}=≠≤≥\"`^")
END, N = 0, len(CLASSES)
assert N < 256 and len(_ID) == N


def _table(**weights) -> np.ndarray:
    return np.array([weights.get(c, 0) for c in CLASSES], np.int64)


_FW_OF = _table(**dict.fromkeys(FUNCTION_WORDS, 1))
_STOP_OF = _table(**dict.fromkeys([".", "!", "?"], 1))


def _tokens(text: str) -> list[tuple[int, str]]:
    """(class, content word in lower case or nothing) of each token; the class of a content word is that of a word not repeated."""
    out = []
    for m in _TOKEN.finditer(text):
        kind, w = m.lastgroup, m.group()
        if kind == "word":
            low = w.lower()
            i = _ID.get(low) if low in FUNCTION_WORDS else None
            out.append((i, "") if i is not None else (_ID["Upper" if len(w) > 1 and w.isupper() else "Title" if w[0].isupper() else "Lower"], low))
        elif kind == "punct":
            out.append((_ID["code sign"] if w in _CODE else _ID.get(w, _ID["sign"]), ""))
        else:
            out.append((_ID[f"<{kind}>"], ""))
    return out


class Reader:
    """Pages to sequences of classes; the tokens of what stands between blanks are remembered, up to a number of entries."""

    def __init__(self, often: int, entries: int = 300_000):
        self.often, self.entries, self.seen = often, entries, {}

    def _chunk(self, chunk: str) -> list[tuple[int, str]]:
        if (t := self.seen.get(chunk)) is None:
            if len(self.seen) >= self.entries:
                self.seen.clear()
            t = self.seen[chunk] = _tokens(chunk)
        return t

    def page(self, text: str) -> tuple[bytes, list[int]]:
        """Classes with an END after each line, and the lines' characters.

        Lines are cut again after a sentence's end. A content word that the page has at least ``often`` times is of a class of its own.
        """
        chunk, lines, chars, count = self._chunk, [], [], Counter()
        for x in _BREAK.split(text):
            if not x or x.isspace():
                continue
            for line in _STOP.split(x):
                tokens = _tokens(line) if _SPACED.search(line) else [t for c in line.split() for t in chunk(c)]
                lines.append(tokens)
                chars.append(len(line))
                count.update([w for _, w in tokens if w])
        seq, often, shift = bytearray(), self.often, len(_SHAPES) // 2
        again = {w for w, n in count.items() if n >= often}
        for tokens in lines:
            seq.extend([i + shift if w in again else i for i, w in tokens])
            seq.append(END)
        return bytes(seq), chars


def _read(often: int, size: int = 2000):
    def run(batches):
        reader, out = Reader(often), []
        schema = pa.schema([("id", pa.int64()), ("seq", pa.binary()), ("chars", pa.list_(pa.int32()))])

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for i, text in zip(*(c.to_pylist() for c in batch.columns)):
                out.append((i, *reader.page(text)))
                if len(out) >= size:
                    yield flush()
        if out:
            yield flush()

    return run


def _lines(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All classes in one array, and the start and end (with the END) of each line."""
    seq = np.frombuffer(b"".join(seqs), np.uint8).astype(np.int64)
    end = np.flatnonzero(seq == END) + 1
    return seq, np.concatenate(([0], end[:-1])), end


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    c = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return c[end] - c[start]


def _trigrams(seq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two classes before each one; END before a line's first."""
    b = np.concatenate(([END], seq[:-1]))
    a = np.concatenate(([END, END], seq[:-2]))[: len(seq)]
    a[start] = END
    return a, b, seq


#: What is counted: trigrams of sentences, of pages judged ok and of pages judged spam, and single classes of all lines.
PROSE, FINE, STUFFED, ALL = range(4)


def _count(batches):
    """(model, code, n) counted in each batch. Sentences have at least six tokens, three function words and a sentence's end."""
    for batch in batches:
        seqs, verdicts = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        seq, start, end = _lines(seqs)
        if not len(seq):
            continue
        sentence = (end - start > 6) & (_sums(_FW_OF[seq], start, end) >= 3) & (_STOP_OF[seq[np.maximum(end - 2, 0)]] > 0)
        a, b, c = _trigrams(seq, start)
        code, of = (a << 16) | (b << 8) | c, np.repeat(verdicts, [len(s) for s in seqs])
        for model, some in ((PROSE, code[np.repeat(sentence, end - start)]), (FINE, code[of == 0]), (STUFFED, code[of == 1]), (ALL, c)):
            found, n = np.unique(some, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), model, np.int32)), pa.array(found), pa.array(n)], names=["model", "code", "n"])


class Model:
    """Interpolated trigram model over classes: the surprise, in bits, of a class after two others.

    Each order leans on the one below with ``weight`` pseudo-counts, single classes on how common they are in the whole corpus; so
    models without any counts all give the same surprise.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, common: np.ndarray, weight: float):
        order = np.argsort(codes)
        self.codes, self.counts, self.weight = codes[order].astype(np.int64), counts[order].astype(float), weight
        a, b, c = self.codes >> 16, (self.codes >> 8) & 255, self.codes & 255
        self.context = np.bincount((a << 8) | b, self.counts, 1 << 16)
        two, before, one = np.bincount((b << 8) | c, self.counts, 1 << 16), np.bincount(b, self.counts, 256), np.bincount(c, self.counts, 256)
        single = (one + weight * common) / (one.sum() + weight)
        self.pair = (two.reshape(256, 256) + weight * single) / (before[:, None] + weight)

    def bits(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        code, n = (a << 16) | (b << 8) | c, np.zeros(len(a))
        if len(self.codes):
            i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            n = np.where(self.codes[i] == code, self.counts[i], 0.0)
        return -np.log2((n + self.weight * self.pair[b, c]) / (self.context[(a << 8) | b] + self.weight))


def fit(grams: np.ndarray, weight: float) -> tuple[Model, Model, Model]:
    """The models of prose, of pages judged ok and of pages judged spam, out of rows (model, code, n)."""
    model, code, n = grams
    common = np.zeros(256)
    common[:N] = 0.5
    common[code[model == ALL]] += n[model == ALL]
    common /= common.sum()
    return tuple(Model(code[model == m], n[model == m], common, weight) for m in (PROSE, FINE, STUFFED))


def _score(models: tuple[Model, Model, Model]):
    """(id, n_chars, stuffed_chars, bits) of each page."""

    def run(batches):
        for batch in batches:
            ids, seqs, chars = (batch.column(i) for i in range(3))
            seqs = seqs.to_pylist()
            seq, start, end = _lines(seqs)
            if not len(seq):
                continue
            grams = _trigrams(seq, start)
            prose, fine, stuffed = (_sums(m.bits(*grams), start, end) for m in models)
            size, found = chars.flatten().to_numpy(), stuffed < np.minimum(prose, fine)
            upto = np.concatenate(([0], np.cumsum([s.count(b"\0") for s in seqs])))
            total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[upto])
            columns = total(size).astype(np.int64), total(size * found).astype(np.int64), total(prose) / np.maximum(1, total(end - start))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names=["id", "n_chars", "stuffed_chars", "bits"])

    return run


def verdicts(labels: DataFrame, most: int) -> DataFrame:
    """``id, spam``: 1 or 0 as most raters of a page say; pages without a majority and other verdicts are left out. Of more than ``most`` pages a sample by hash."""
    once = labels.where(F.col("id").isNotNull() & F.col("verdict").isin("spam", "ok")).distinct()
    votes = once.groupBy("id").agg(F.sum(F.when(F.col("verdict") == "spam", 1).otherwise(-1)).alias("for")).where(F.col("for") != 0)
    return votes.select("id", (F.col("for") > 0).cast("int").alias("spam")).orderBy(F.xxhash64("id"), "id").limit(most)


def page_scores(docs: DataFrame, labels: DataFrame, often: int = 4, weight: float = 30.0, most_labels: int = 100_000) -> DataFrame:
    """``id, n_chars, stuffed_chars, bits``: for each page (``id, text``) its characters, those in lines of keywords, links, tags or products, and
    the mean surprise of its tokens under the prose model (the binary logarithm of its perplexity).

    A page is read once, as sequences of function words, signs and word classes (case, identifiers, numbers, links, tags, prices,
    article numbers; content words that the page repeats ``often`` times are classes of their own). The prose model is an
    n-gram model of the trigrams of all sentences of the corpus. What counts as abnormal is fitted to judged pages (``id, verdict`` and
    what else tells judgements apart; at most ``most_labels`` pages): the same model of the pages judged ok says how far text that is no prose (code,
    logs, lists of fields) may stray from it, that of the pages judged spam what stuffed text looks like. A line is stuffed if its perplexity under
    the prose model and under that of fine pages is higher than under that of stuffed ones. Nothing else decides: no threshold, no word list of offers.

    Counts are taken within tasks before the shuffle; at most the cube of the number of classes comes to the driver. Null and blank
    texts and rows without an id are left out; rows given twice count once; empty tables give no rows; without any judged page
    all models agree and no line is stuffed; very long pages are read whole.
    """
    st = Stages(docs.sparkSession, "spam")
    texts = docs.where((F.trim("text") != "") & F.col("id").isNotNull()).select("id", "text")
    pages = st.put(map_batches(texts, _read(often), "id long, seq binary, chars array<int>"), "read")
    judged = pages.select("id", "seq").join(F.broadcast(verdicts(labels, most_labels)), "id", "left").select("seq", F.coalesce("spam", F.lit(-1)).alias("spam"))  # most_labels rows
    grams = map_batches(judged, _count, "model int, code long, n long").groupBy("model", "code").agg(F.sum("n").alias("n")).toPandas()
    models = fit(grams.to_numpy(np.int64).T, weight)
    return map_batches(pages, _score(models), "id long, n_chars long, stuffed_chars long, bits double").distinct()


def spam_pages(docs: DataFrame, labels: DataFrame, share: float = 0.6) -> DataFrame:
    """``id`` of the pages with more than ``share`` of their characters in stuffed lines."""
    return page_scores(docs, labels).where(F.col("stuffed_chars") > share * F.col("n_chars")).select("id").distinct()
