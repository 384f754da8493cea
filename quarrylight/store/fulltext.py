"""A stored full-text index: posting blocks by term, segments, tombstones.

Every unit (a document, a line window, a symbol) has a number. Numbers are dense within a
segment, which is what one call of ``add`` writes. A posting row is a term with the units
of one block of 2^BITS numbers that hold it, in order, and how many they are; so a row has
a bounded size however common its term is, and the buckets, which are by the hash of the
term, spread a common term's rows over several files. A query reads the buckets of its own
terms, and of those first the terms, blocks and counts alone: only blocks that hold every
term of a query give their units. The rarest term's are met with every other term's where
those lie, so long lists are read and not sent on once for each query.

Units are deleted by tombstones, which a query subtracts; an update deletes and adds.
``compact`` rewrites all segments as one without the dead. Postings hold no text, and no
call but ``add`` reads any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens_of
from ..operators.places import numbered
from .buckets import Change, Store

BITS = 14


def _blocks(pairs: DataFrame) -> DataFrame:
    """term, block, n, units of distinct (term, unit): the units as distances from the block's first number, in order."""
    block = F.shiftright("unit", BITS)
    offset = (F.col("unit") - F.shiftleft(block, BITS)).cast("int")
    made = pairs.select("term", block.alias("block"), offset.alias("offset")).groupBy("term", "block").agg(F.sort_array(F.collect_list("offset")).alias("units"))
    return made.select("term", "block", F.size("units").alias("n"), "units")


class FullText:
    """The index ``name`` of a store; keys: what names a unit; buckets: of a new index."""

    def __init__(self, store: Store, name: str, keys: list[str], buckets: int = 64):
        self.store, self.name, self.keys = store, name, keys
        self.state = store.values.get(f"fulltext {name}", {"next": 0, "segments": [], "dead": [], "buckets": buckets})
        self.buckets = self.state["buckets"]  # the same in every segment

    def _table(self, kind: str) -> str:
        return f"{self.name}_{kind}"

    def _read(self, kind: str, buckets: list[int] | None = None) -> DataFrame | None:
        own = [self.store.read(f"{self._table(kind)}_{s}", buckets) for s in self.state["dead" if kind == "dead" else "segments"]]
        return reduce(DataFrame.unionByName, own) if own else None

    def units(self) -> DataFrame | None:
        """unit and keys of all live units."""
        own, dead = self._read("units"), self._read("dead")
        return own if own is None or dead is None else own.join(dead, "unit", "left_anti")

    # Changes ---------------------------------------------------------------------------

    def add(self, change: Change, rows: DataFrame, text: Column) -> None:
        """A new segment of ``rows`` (the keys and what ``text`` refers to)."""
        state, number = self._state(change), change.number
        first = -(-state["next"] // (1 << BITS)) << BITS  # a block is of one segment
        scratch = f"{self.store.folder.root}/_scratch/{change.mark}-{self.name}"
        own = numbered(rows.select(*self.keys, F.array_distinct(tokens_of(text)).alias("terms")), first, scratch)
        segment = f"{number:08d}"
        change.write(f"{self._table('units')}_{segment}", own.select("unit", *self.keys), "unit", self.buckets)
        change.write(f"{self._table('posts')}_{segment}", _blocks(own.select("unit", F.explode("terms").alias("term"))), "term", self.buckets)
        state["next"] = first + own.count()
        state["segments"].append(segment)
        self.store.folder.delete(f"_scratch/{change.mark}-{self.name}")

    def remove(self, change: Change, gone: DataFrame) -> None:
        """Tombstones of the live units whose key is in ``gone``, which has some of the keys; reads numbers and keys, no postings."""
        live = self.units()
        if live is None:
            return
        state = self._state(change)
        dead = live.join(gone.distinct(), gone.columns, "left_semi").select("unit")
        change.write(f"{self._table('dead')}_{change.number:08d}", dead, "unit", self.buckets)
        state["dead"].append(f"{change.number:08d}")

    def compact(self, change: Change) -> None:
        """One segment of all live units, numbered anew; older segments and tombstones are not named any more."""
        live = self.units()
        if live is None:
            return
        old, number = self._state(change), change.number
        scratch = f"{self.store.folder.root}/_scratch/{change.mark}-{self.name}"
        own = numbered(live.withColumnRenamed("unit", "old").repartitionByRange("old"), 0, scratch)
        offset = F.explode("units")
        pairs = self._read("posts").select("term", "block", offset.alias("offset")).select("term", (F.shiftleft("block", BITS) + F.col("offset")).alias("old"))
        change.write(f"{self._table('units')}_{number:08d}", own.select("unit", *self.keys), "unit", self.buckets)
        change.write(f"{self._table('posts')}_{number:08d}", _blocks(pairs.join(own.select("old", "unit"), "old").select("term", "unit")), "term", self.buckets)
        for kind in ("segments", "dead"):
            for s in old[kind]:
                for table in ("units", "posts") if kind == "segments" else ("dead",):
                    change.tables.pop(f"{self._table(table)}_{s}", None)
        change.values[f"fulltext {self.name}"] = {"next": own.count(), "segments": [f"{number:08d}"], "dead": [], "buckets": self.buckets}
        self.store.folder.delete(f"_scratch/{change.mark}-{self.name}")

    def _state(self, change: Change) -> dict:
        return change.values.setdefault(f"fulltext {self.name}", {"next": 0, "segments": [], "dead": [], "buckets": self.buckets})

    # Queries ---------------------------------------------------------------------------

    def _posts(self, terms: DataFrame) -> DataFrame | None:
        """Posting rows of the buckets that the terms fall into."""
        if not self.state["segments"]:
            return None
        buckets = self.store.buckets_of(f"{self._table('posts')}_{self.state['segments'][0]}", terms.select("term"))
        return self._read("posts", buckets)

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """term, n: live units that hold each term (column ``term``)."""
        posts, dead = self._posts(terms), self._read("dead")
        if posts is None:
            return terms.select("term", F.lit(0).cast("long").alias("n")).limit(0)
        own = posts.join(terms.select("term").distinct(), "term", "left_semi")
        if dead is None:
            return own.groupBy("term").agg(F.sum("n").alias("n"))
        each = own.select("term", "block", F.explode("units").alias("offset")).select("term", (F.shiftleft("block", BITS) + F.col("offset")).alias("unit"))
        return each.join(dead, "unit", "left_anti").groupBy("term").agg(F.count("*").alias("n"))

    def match(self, terms: DataFrame) -> DataFrame:
        """query_id and keys of units that hold all terms of a query (query_id, term)."""
        terms = terms.select("query_id", "term").distinct()
        posts = self._posts(terms)
        if posts is None:
            empty = self.store.spark.createDataFrame([], "query_id long")
            return empty.select("query_id", *(F.lit(None).cast("string").alias(k) for k in self.keys))
        wanted = terms.groupBy("query_id").agg(F.count("*").alias("wanted"))
        heads = posts.select("term", "block", "n").join(terms, "term")
        full = heads.groupBy("query_id", "block").agg(F.count("*").alias("has")).join(wanted, "query_id").where("has = wanted").select("query_id", "block")
        asked = heads.join(full, ["query_id", "block"])
        rarest = asked.groupBy("query_id", "block").agg(F.min(F.struct("n", "term"))["term"].alias("term"))
        few = posts.join(rarest, ["term", "block"]).select("query_id", "block", "term", F.col("units").alias("few"))
        rest = asked.select("query_id", "block", "term").join(few.withColumnRenamed("term", "rarest"), ["query_id", "block"]).where("term <> rarest")
        kept = posts.join(rest, ["term", "block"]).select("query_id", "block", F.array_intersect("few", "units").alias("own"))  # of long lists no more than that goes on
        lists = kept.unionByName(few.select("query_id", "block", F.col("few").alias("own"))).groupBy("query_id", "block").agg(F.collect_list("own").alias("lists"))
        common = F.aggregate("lists", F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
        hits = lists.select("query_id", "block", F.explode(common).alias("offset")).select("query_id", (F.shiftleft("block", BITS) + F.col("offset")).alias("unit"))
        dead = self._read("dead")
        hits = hits if dead is None else hits.join(dead, "unit", "left_anti")
        return hits.join(self._read("units"), "unit").select("query_id", *self.keys)
