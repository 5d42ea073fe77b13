"""Full-text search over names and bodies: an inverted index, a small query language, BM25 and snippets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import Stages
from graphloom.functions.text import json_field, parsed
from graphloom.operators.graph import Graph
from graphloom.operators.hierarchy import ancestors

# Accented Latin letters and what they are searched as.
ACCENTED = "áàâäãåāçčćéèêëēęěíìîïīłñńňóòôöõøōřśšťúùûüūůýÿžźż"
PLAIN = "aaaaaaaccceeeeeeeiiiiilnnnooooooorsstuuuuuuyyzzz"
assert len(ACCENTED) == len(PLAIN)
K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    """Words (letters, digits, private use) in lower case without accents."""
    low = F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN)
    return F.filter(F.split(low, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def bubbled(texts: DataFrame) -> DataFrame:
    """``texts`` (``entity_id, kind, parent_entity_id, own`` and others) with ``body``: the own text and, for layouts and their objects, those of all objects below, in document order."""
    tree = texts.where("kind in ('layout', 'layout_object')")
    parents = tree.select(F.col("entity_id").alias("up"))
    links = tree.where("kind = 'layout_object'").select(F.col("entity_id").alias("id"), F.col("parent_entity_id").alias("up")).join(parents, "up", "left_semi")
    parts = tree.where(F.trim("own") != "").select(F.col("entity_id").alias("id"), "own").join(ancestors(links), "id")
    below = parts.groupBy(F.col("anc").alias("entity_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "own"))), lambda t: t["own"]).alias("below"))
    return texts.join(below, "entity_id", "left").withColumn("body", F.concat_ws(" ", F.nullif("own", F.lit("")), "below")).drop("below")


def text_docs(g: Graph) -> DataFrame:
    """``entity_id, file_id, kind, name, body``: everything of an entity that can be searched, layouts and objects with all that is on them; entities without any text are left out."""
    v = F.col("extra")
    get = lambda path: F.try_variant_get(v, path, "string")
    e = g.entities.select("entity_id", "file_id", "kind", "name", "parent_entity_id", "calc_text", "auto_enter", parsed("extra_json").alias("extra"))
    values = F.array_join(F.try_variant_get(v, "$.custom_values", "array<string>"), " ")
    own = F.concat_ws(" ", "name", get("$.object_type"), "calc_text", get("$.step_text"), get("$.hide_calc"), get("$.tooltip_calc"), json_field("auto_enter", "$.calc"), get("$.validation_calc"), get("$.text"), values)
    texts = Stages(e.sparkSession, "texts").put(e.select("entity_id", "file_id", "kind", "name", "parent_entity_id", own.alias("own")), "own")
    return bubbled(texts).select("entity_id", "file_id", "kind", "name", "body").where(F.trim("body") != "")


def indexed(docs: DataFrame) -> DataFrame:
    """``docs`` with, for names and bodies, the words with a blank before, between and after (``name_norm``, ``body_norm``)."""
    norm = lambda c: F.concat(F.lit(" "), F.array_join(tokens(F.col(c)), " "), F.lit(" "))
    return docs.withColumns({"name_norm": norm("name"), "body_norm": norm("body")})


#: Parts of a stored index; a query reads those that its words fall into.
PARTS = 64


def postings(docs: DataFrame) -> DataFrame:
    """``term, entity_id, col, pos, part``: the inverted index. ``part`` is the term's first character's, so that prefixes are found in one part as well."""
    rows = [docs.select("entity_id", F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "term")) for c in ("name", "body")]
    return rows[0].unionByName(rows[1]).select("term", "entity_id", "col", "pos", _part(F.substring("term", 1, 1)).alias("part"))


def _part(first: Column) -> Column:
    return F.pmod(F.ascii(first), F.lit(PARTS))


def lengths(docs: DataFrame) -> DataFrame:
    """``entity_id, kind, name, body, n_tokens``: what ranking and snippets need of each document."""
    return docs.select("entity_id", "kind", "name", "body", (F.size(tokens(F.col("name"))) + F.size(tokens(F.col("body")))).alias("n_tokens"))


class Query:
    """Words, "phrases", prefixes*, col:x, NEAR(a b, n), AND, OR, NOT and parentheses; what doesn't parse is searched as one literal phrase.

    NEAR holds where at most n words (10 if not said) lie between the first and the last of its words or phrases, in any order.
    Precedence is NOT over AND over OR; words side by side mean AND.
    """

    def __init__(self, text: str):
        self.phrases: list[tuple[str | None, list[str], bool]] = []
        self.nears: list[tuple[list[int], int]] = []
        try:
            self._rest = re.findall(r'"(?:[^"]|"")*"|[()]|[^\s()"]+|"', text)
            self.node = self._or()
            if self._rest:
                raise ValueError(text)
        except ValueError:
            self.phrases, self.nears = [], []
            self.node = self._leaf(None, text, False)

    def _peek(self) -> str | None:
        return self._rest[0] if self._rest else None

    def _or(self):
        left = self._and()
        while self._peek() == "OR":
            self._rest.pop(0)
            left = ("or", left, self._and())
        return left

    def _and(self):
        left = self._not()
        while (t := self._peek()) is not None and t not in ("OR", ")", "NOT"):
            if t == "AND":
                self._rest.pop(0)
                if self._peek() == "NOT":
                    self._rest.pop(0)
                    left = ("not", left, self._unit())
                    continue
            left = ("and", left, self._not())
        return left

    def _not(self):
        left = self._unit()
        while self._peek() == "NOT":
            self._rest.pop(0)
            left = ("not", left, self._unit())
        return left

    def _unit(self):
        if not self._rest:
            raise ValueError("end")
        t = self._rest.pop(0)
        if t == "(":
            inner = self._or()
            if not self._rest or self._rest.pop(0) != ")":
                raise ValueError("parenthesis")
            return inner
        if t == "NEAR" and self._peek() == "(":
            return self._near()
        if t in (")", "AND", "OR", "NOT", '"', "NEAR"):
            raise ValueError(t)
        col = None
        if m := re.fullmatch(r"(name|body):(.*)", t):
            col, t = m.groups()
            if not t:
                if not self._rest:
                    raise ValueError("column")
                t = self._rest.pop(0)
        if t.startswith('"'):
            return self._leaf(col, t[1:-1].replace('""', '"'), False)
        if not re.fullmatch(r"[\w\x80-\U0010ffff]+\*?", t):
            raise ValueError(t)
        return self._leaf(col, t.rstrip("*"), t.endswith("*"))

    def _near(self):
        inside = self._rest[1 : self._rest.index(")")]
        del self._rest[: len(inside) + 2]
        words, _, distance = " ".join(inside).partition(",")
        leaves = [self._leaf(None, w.strip('"').replace('""', '"'), False)[1] for w in re.findall(r'"(?:[^"]|"")*"|[^\s"]+', words)]
        if len(leaves) < 2 or not all(self.phrases[i][1] for i in leaves):
            raise ValueError("NEAR")
        self.nears.append((leaves, int(distance) if distance.strip() else 10))
        return ("near", len(self.nears) - 1)

    def _leaf(self, col: str | None, text: str, prefix: bool):
        low = text.lower().translate(str.maketrans(ACCENTED, PLAIN))
        self.phrases.append((col, re.findall(r"[^\W_]+", low), prefix))
        return ("leaf", len(self.phrases) - 1)

    def found(self, posts: DataFrame) -> DataFrame:
        """``entity_id, n0, n1, ...``: how often each phrase occurs in the entities where any does, out of ``postings``.

        Only postings of the query's words are read. Each says where a phrase would begin; it does where all its words agree.
        """
        words = [(i, j, w, col, prefix and j == len(ws) - 1, len(ws)) for i, (col, ws, prefix) in enumerate(self.phrases) for j, w in enumerate(ws)]
        if not words:
            return posts.select("entity_id").limit(0)
        fits = [(F.col("term").startswith(w) if prefix else F.col("term") == w) & (F.lit(True) if col is None else F.col("col") == col) for _, _, w, col, prefix, _ in words]
        said = F.array(*[F.when(f, F.struct(F.lit(i).alias("phrase"), F.lit(j).alias("shift"), F.lit(n).alias("n"))) for f, (i, j, _, _, _, n) in zip(fits, words)])
        wanted = posts.where(F.col("part").isin(*sorted({ord(w[0]) % PARTS for _, _, w, *_ in words})) & reduce(Column.__or__, fits))
        places = wanted.select("entity_id", "col", "pos", F.explode(F.filter(said, lambda x: x.isNotNull())).alias("x"))
        begins = places.groupBy("entity_id", "col", "x.phrase", "x.n", (F.col("pos") - F.col("x.shift")).alias("at")).agg(F.count(F.lit(1)).alias("words")).where(F.col("words") == F.col("n"))
        for i, (leaves, distance) in enumerate(self.nears):
            # the phrases that begin at or before this one, ending at most so many words before it
            before = Window.partitionBy("entity_id", "col").orderBy("at").rangeBetween(-distance - max(len(self.phrases[x][1]) for x in leaves), 0)
            own = F.when(F.col("phrase").isin(*leaves) & F.col("n").isNotNull(), F.struct("phrase", (F.col("at") + F.col("n")).alias("end")))
            met = F.array_distinct(F.transform(F.filter(F.collect_list(own).over(before), lambda x: F.col("at") - x["end"] <= distance), lambda x: x["phrase"]))
            begins = begins.withColumn(f"near{i}", F.size(met) == len(leaves))
        counts = [F.count_if(F.col("phrase") == i).alias(f"n{i}") for i in range(len(self.phrases))]
        return begins.groupBy("entity_id").agg(*counts, *[F.count_if(f"near{i}").alias(f"m{i}") for i in range(len(self.nears))])

    def holds(self, node=None) -> Column:
        """Whether the counts of ``found`` fulfil the query."""
        op, *parts = node or self.node
        if op == "leaf":
            return F.col(f"n{parts[0]}") > 0 if self.phrases[parts[0]][1] else F.lit(False)
        if op == "near":
            return F.col(f"m{parts[0]}") > 0
        a, b = self.holds(parts[0]), self.holds(parts[1])
        return a & b if op == "and" else a | b if op == "or" else a & ~b

    def matches(self, node=None) -> Column:
        """Whether a row of ``indexed`` matches: a predicate without any state, for texts that arrive as a stream."""
        op, *parts = node or self.node
        if op == "leaf":
            col, words, prefix = self.phrases[parts[0]]
            if not words:
                return F.lit(False)
            needle = F.lit(" " + " ".join(words) + ("" if prefix else " "))
            found = [F.contains(F.col(f"{c}_norm"), needle) for c in ([col] if col else ["name", "body"])]
            return found[0] if len(found) == 1 else found[0] | found[1]
        if op == "near":
            leaves, distance = self.nears[parts[0]]
            if len(leaves) > 2:
                raise ValueError("NEAR of more than two words needs the index")
            x, y = (" ".join(map(re.escape, self.phrases[i][1])) for i in leaves)
            pattern = F.lit("|".join(rf" {p}(?: \S+){{0,{distance}}} {q} " for p, q in ((x, y), (y, x))))
            return F.rlike("name_norm", pattern) | F.rlike("body_norm", pattern)
        a, b = self.matches(parts[0]), self.matches(parts[1])
        return a & b if op == "and" else a | b if op == "or" else a & ~b


def matching(posts: DataFrame, text: str) -> DataFrame:
    """``entity_id`` of the documents that match, out of ``postings``."""
    q = Query(text)
    found = q.found(posts)
    return found.where(q.holds()).select("entity_id") if any(w for _, w, _ in q.phrases) else found


def search(posts: DataFrame, docs: DataFrame, text: str, limit: int | None = 50, window: int = 12) -> DataFrame:
    """``entity_id, kind, name, match, score`` of the documents that match, best first (BM25, k1 1.2, b 0.75), at most ``limit``.

    ``posts`` is the inverted index, ``docs`` its documents with their lengths. match is a window of the body's words around the first hit, which stands in brackets;
    the smallest entity_id wins ties. A query without words matches nothing. How many documents hold a phrase comes from the index, their number and mean length from ``docs``.
    """
    q = Query(text)
    if not any(w for _, w, _ in q.phrases):
        return docs.select("entity_id", "kind", "name", F.col("body").alias("match"), F.lit(0.0).alias("score")).limit(0)
    found = Stages(posts.sparkSession, "found").put(q.found(posts), "found")  # the index is read once, for the counts and for the ranking
    some = range(len(q.phrases))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean")).first()
    held = found.agg(*[F.count_if(F.col(f"n{i}") > 0).alias(f"df{i}") for i in some]).first()
    score = F.lit(0.0)
    for i in some:
        f = F.col(f"n{i}")
        idf = F.greatest(F.lit(1e-6), F.log((F.lit(stats.n) - held[f"df{i}"] + 0.5) / (F.lit(held[f"df{i}"]) + 0.5)))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_tokens") / F.lit(stats.mean or 1.0)))
    best = found.where(q.holds()).join(docs, "entity_id").withColumn("score", score).orderBy(F.desc(F.round("score", 9)), "entity_id")
    if limit is not None:
        best = best.limit(limit)
    return best.select("entity_id", "kind", "name", _snippet(q, window).alias("match"), "score")


def _snippet(q: Query, window: int) -> Column:
    words = F.split(F.trim("body"), r"\s+")
    heads = [w[0] for _, w, _ in q.phrases if w] or ["\x00"]
    alone = F.transform(words, lambda w: F.translate(F.lower(w), ACCENTED, PLAIN))

    def place(head: str) -> Column:
        return F.nullif(F.array_position(F.transform(alone, lambda w: F.contains(w, F.lit(head))), F.lit(True)), F.lit(0).cast("long"))

    first = F.coalesce(*map(place, heads), F.lit(1).cast("long"))
    start = F.greatest(F.lit(1), first - window // 2).cast("int")
    mark = F.transform(words, lambda w, i: F.when(i == first - 1, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    part = F.array_join(F.slice(mark, start, window), " ")
    return F.concat(F.when(start > 1, "...").otherwise(""), part, F.when(F.size(words) >= start + window, "...").otherwise(""))
