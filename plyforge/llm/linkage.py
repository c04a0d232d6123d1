"""Deduplicating new batches against all history by incremental record linkage.

Accepted records are kept in persisted tables of blocking keys (``runs``), each identity (a digest of the usual form of
what a record shows) under

* its identity, with the smallest rec_id that showed it;
* its placement (the pieces on the board), so that other sides to move, rights and en passant squares meet;
* with ``near``, four keys of its side to move and all ranks but two (r and r + 4), so that boards of which one rank is
  damaged, even to a text that is no position, meet.

A batch is reduced to its distinct identities, these probe the tables, and every pair found is scored field by field
with learned weights; a record that repeats an identity is scored against the first record of it. Pairs above the
threshold are links. Union-find over the touched clusters (``merge``) keeps a persisted mapping of linked identities to
representatives, one that is linked to nothing but its repeats to itself. Links of different identities are
near-duplicates. ``found`` are the linked records of one cluster that pass the exact check: one identity.

Weights: log2(m / u) where a field agrees, log2((1 - m) / (1 - u)) where it differs, but the origin (game, ply, dump)
never counts against a pair: positions recur in other games; u, the chance that unrelated
records agree, from the value frequencies of all history (for the board: from its share among all candidate pairs); m,
that records of one cluster do: for game, ply and dump from the exact repeats of history (first against last record of
each identity), for what a position shows, as for the prior, by expectation maximisation over the agreement patterns of
all candidate pairs of different identities of history, exact repeats left out. The threshold is never above the score of two
records that show one position and say nothing of its origin.

Everything needed to go on is kept under ``path``: tables, weights, links and representatives, committed together once a
round. A linker that finds them there reads no history.

Blocks: equal records are one identity. A placement has at most sides x castling rights x files identities; a near block
holds boards that agree on the side and on 48 squares, and of its pairs only those one character apart are kept. Pairs of
one input lie side by side in the run it was written to (``RunStore.twins``), so no block is gathered or joined.

Nulls: a record without text is known by its key alone, and compared when a record with its text arrives; one with
neither is linked to nothing. A text that is no position is identified by the digest of its first four fields as
written. A field that is null on either side counts for nothing. Empty inputs give empty results.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge import session
from plyforge.functions import keys
from plyforge.functions.position import squares, usual_parts
from plyforge.llm.runs import Rounds, RunStore, rounds
from plyforge.llm.union_find import components
from plyforge.operators.skew import hot_join

#: Fields that are scored: of the position, then of its origin.
SHOWN, ORIGIN = ("board", "side", "castling", "ep"), ("game", "ply", "dump")
FIELDS = SHOWN + ORIGIN
RECORD = "rec_id bigint, batch_no int, ident bigint, place bigint, board string, state string, game int, ply smallint, dump int"
_TOLD = "state string, game int, ply smallint, dump int"
#: Of each identity of a round: its records there, and the first record, of before if there is one.
KNOWN = f"ident bigint, n bigint, first bigint, {_TOLD}"
LINK = "ident bigint, rep bigint, score double"
#: What is scored of a pair.
PAIR = ("ident", "old_ident", *[p + c for p in ("", "old_") for c in ("state", *ORIGIN)])
#: Of a pair of near boards what the near table tells; the origins are looked up by identity.
NEAR_PAIR = "ident bigint, old_ident bigint, state string, old_state string"


def _shown(near: bool):
    """What each text shows: digest of its usual form, of its placement, the 64 squares, and the fields after; nulls for null.

    With ``near`` the squares are given, and a text that is no position has no placement, but squares and fields as
    written where it has eight ranks and a side.
    """

    @F.arrow_udf(T.StructType().add("ident", T.LongType()).add("place", T.LongType()).add("board", T.StringType()).add("state", T.StringType()))
    def shown(fen: pa.Array) -> pa.Array:
        ident, place, boards, states = [], [], [], []
        for text in fen.to_pylist():
            usual = usual_parts(text)
            board = state = None
            if usual is not None:
                placement, board, state = usual
                ident.append(keys.digest64(f"{placement} {state}"))
                place.append(keys.digest64(placement))
            else:
                part = [] if text is None or not near else text.replace("_", " ").split()
                if len(part) > 1 and part[0].count("/") == 7 and part[1].lower() in ("w", "b"):
                    board, state = squares(part[0]), " ".join([part[1].lower(), *part[2:4]])
                ident.append(None if text is None else keys.digest64(" ".join(text.split(" ")[:4])))
                place.append(None)
            boards.append(board if near else None)
            states.append(state)
        columns = [pa.array(ident, pa.int64()), pa.array(place, pa.int64()), pa.array(boards, pa.string()), pa.array(states, pa.string())]
        return pa.StructArray.from_arrays(columns, names=["ident", "place", "board", "state"])

    return shown


def records(
    table: DataFrame, key: Column, batch: Column, game: Column | None = None, ply: Column | None = None, dump: Column | None = None, near: bool = True
) -> DataFrame:
    """RECORD of a table with rec_id and fen; ``key`` is its key as signed number, the others what is said of its origin.

    Without ``near`` the squares, which only near keys need, are null.
    """
    null = F.lit(None)
    t = table.select(
        "rec_id", batch.cast("int").alias("batch_no"), key.alias("_key"), _shown(near)("fen").alias("s"),
        *[(null if c is None else c).alias(f"_{name}") for name, c in zip(ORIGIN, (game, ply, dump))],
    )
    # selected before they are used twice, for which references would be read twice as often
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.hash(c))
    t = t.withColumns({"game": hashed("_game").cast("int"), "ply": F.when(F.col("_ply") >= 0, F.col("_ply")).cast("smallint"), "dump": hashed("_dump").cast("int")})
    return t.select("rec_id", "batch_no", F.coalesce("s.ident", "_key").alias("ident"), "s.place", "s.board", "s.state", "game", "ply", "dump")


def _identities(rows: DataFrame, repeats: bool = False) -> DataFrame:
    """Each identity with its first record's origin; all texts of an identity show the same.

    With ``repeats``, flags say whether the origins of its first and its last record agree (null for a single record).
    """
    origin = F.struct(*ORIGIN)
    got = rows.filter("ident is not null").groupBy("ident").agg(
        F.min("rec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("place").alias("place"), F.max("board").alias("board"), F.max("state").alias("state"),
        F.min_by(origin, "rec_id").alias("_o"), *([F.max_by(origin, "rec_id").alias("_l")] if repeats else []),
    )
    flags = [F.when(F.col("n") > 1, F.col(f"_o.{c}") == F.col(f"_l.{c}")).alias(f"same_{c}") for c in ORIGIN] if repeats else []
    return got.select("ident", "first", "n", "place", "board", "state", *[f"_o.{c}" for c in ORIGIN], *flags)


def _agreement(board: Column) -> dict[str, Column]:
    """Which fields agree in a pair (columns and ``old_`` columns); null where either side has none."""
    left, right = F.split("state", " "), F.split("old_state", " ")
    flags = {"board": board}
    flags |= {name: F.get(left, F.lit(k)) == F.get(right, F.lit(k)) for k, name in enumerate(SHOWN[1:])}
    return flags | {name: F.col(name) == F.col(f"old_{name}") for name in ORIGIN}


@dataclass(frozen=True)
class Weights:
    """Of each of FIELDS: the chance to agree in records of one cluster and in unrelated ones; and the prior of a pair."""

    m: tuple[float, ...]
    u: tuple[float, ...]
    prior: float

    @staticmethod
    def _agrees(name: str, m: float, u: float) -> float:
        """What agreement in a field counts; where repeats share an origin less often than others do, it is no evidence."""
        return math.log2(m / u) if name in SHOWN else max(0.0, math.log2(m / u))

    def odds(self, flags: dict[str, bool | None]) -> float:
        """Log2 odds that two records are one; a field that is missing counts for nothing."""
        out = math.log2(self.prior / (1 - self.prior))
        for name, m, u in zip(FIELDS, self.m, self.u):
            if flags.get(name):
                out += self._agrees(name, m, u)
            elif flags.get(name) is not None and name in SHOWN:
                out += math.log2((1 - m) / (1 - u))
        return out

    def score(self, flags: dict[str, Column]) -> Column:
        """The same of columns."""
        out = F.lit(math.log2(self.prior / (1 - self.prior)))
        for name, m, u in zip(FIELDS, self.m, self.u):
            differs = math.log2((1 - m) / (1 - u)) if name in SHOWN else 0.0
            out = out + F.when(flags[name], self._agrees(name, m, u)).when(~flags[name], differs).otherwise(0.0)
        return out

    def limit(self, threshold: float) -> float:
        """The score from which a pair is linked: that of ``threshold``, or of a repeat from elsewhere if that is lower."""
        return min(math.log2(threshold / (1 - threshold)), self.odds(dict.fromkeys(SHOWN, True)))


def learn_weights(
    patterns: list[tuple[tuple[bool | None, ...], int]], u: list[float], origin: list[tuple[int, int]], steps: int = 60, pseudo: float = 20.0
) -> Weights:
    """The weights from counted agreement patterns of candidate pairs, u and what repeats say of their origin.

    m of the origin's fields is that of repeats, counted as (agreeing, all); m of the shown fields and the prior come by
    expectation maximisation. ``pseudo`` imagined pairs (that agree in nine of ten cases, in origin in every second)
    keep both off their limits where there are few.
    """
    low = 0.01
    u = [min(1 - low, max(low, x)) for x in u]
    fixed = [min(1 - low, max(low, (a + pseudo / 2) / (n + pseudo))) for a, n in origin]
    m, prior = [0.9] * len(SHOWN) + fixed, 0.5
    # an origin that differs is no evidence, as in the score
    patterns = [(tuple(flags[: len(SHOWN)]) + tuple(f or None for f in flags[len(SHOWN) :]), n) for flags, n in patterns]
    for _ in range(steps):
        weight, pairs = 0.0, 0
        seen, agree = [0.0] * len(u), [0.0] * len(u)
        for flags, n in patterns:
            like_m = prior * math.prod(1.0 if f is None else a if f else 1 - a for f, a in zip(flags, m))
            like_u = (1 - prior) * math.prod(1.0 if f is None else b if f else 1 - b for f, b in zip(flags, u))
            share = n * like_m / (like_m + like_u)
            weight += share
            pairs += n
            seen = [x + share * (f is not None) for x, f in zip(seen, flags)]
            agree = [x + share * bool(f) for x, f in zip(agree, flags)]
        m = [min(1 - low, max(low, (a + 0.9 * pseudo) / (s + pseudo))) for a, s in zip(agree[: len(SHOWN)], seen)] + fixed
        prior = min(1 - low, max(low, (weight + pseudo / 2) / (pairs + pseudo)))
    return Weights(tuple(m), tuple(u), prior)


class Linker:
    """The persisted state under ``path``: blocking-key tables, weights, links, representatives."""

    def __init__(self, spark: SparkSession, path: str, rows_per_file: int, threshold: float, near: bool):
        self.spark, self.path, self.near = spark, path, near
        text = session.read_text(spark, f"{path}/state.json")
        state = json.loads(text) if text else {}
        if state and state["near"] != near:
            raise ValueError(f"the linker at {path} was begun with near={state['near']}")
        options = {"rows_per_file": rows_per_file, "owned": True, "dictionary": ("state", "ply", "dump")}
        self.stores = {
            "ident": RunStore(spark, f"{path}/ident", payload=f"first bigint, {_TOLD}", **options),
            "place": RunStore(spark, f"{path}/place", payload=f"ident bigint, {_TOLD}", **options),
            "near": RunStore(spark, f"{path}/near", payload="ident bigint, board string, state string", **options),
            "reps": RunStore(spark, f"{path}/reps", payload="rep bigint", least=True, **options),
        }
        for name, kept in state.get("stores", {}).items():
            self.stores[name].restore(kept)
        self.weights = Weights(**{k: tuple(v) if isinstance(v, list) else v for k, v in state["weights"].items()}) if state else None
        self.threshold, self.merged = state.get("threshold", threshold), state.get("merged", 0)
        self.links = Rounds(spark, f"{path}/links", LINK, state.get("linked", 0))
        self.pairs, self.scored = Rounds(spark, f"{path}/pairs", NEAR_PAIR, state.get("paired", 0)), state.get("scored", 0)
        self.state_is_new = not state

    def _commit(self) -> None:
        """Put all tables' new runs in force at once."""
        state = {"near": self.near, "threshold": self.threshold, "weights": asdict(self.weights), "linked": self.links.done, "merged": self.merged}
        state |= {"paired": self.pairs.done, "scored": self.scored}
        session.write_text(self.spark, f"{self.path}/state.json", json.dumps(state | {"stores": {k: s.state for k, s in self.stores.items()}}))
        for store in self.stores.values():
            store.clean()

    def _near_rows(self, ids: DataFrame) -> DataFrame:
        """(key, ident, board: the two ranks the key leaves out, state) of identities with squares, four of each."""
        rank = lambda r: F.get("_ranks", F.lit(r))
        rest = lambda k: F.xxhash64(F.lit(k), "_side", *[rank(r) for r in range(8) if r % 4 != k])
        some = F.array(*[F.struct(rest(k).alias("key"), F.concat_ws("/", rank(k), rank(k + 4)).alias("part")) for k in range(4)])
        t = ids.filter("board is not null and state is not null").select("ident", "state", F.split("board", "/").alias("_ranks"), F.substring_index("state", " ", 1).alias("_side"))
        t = t.withColumn("_k", F.explode(some))
        return t.select("_k.key", "ident", F.col("_k.part").alias("board"), "state")

    def _apart(self, near: DataFrame) -> DataFrame:
        """NEAR_PAIR of the pairs of near keys that are one character apart in one rank."""
        # both parts have one slash, so a single edit lies within a rank
        one = F.levenshtein("board", "old_board", 1) == 1
        return near.filter("ident != old_ident and board != old_board").filter(one).select(*T.StructType.fromDDL(NEAR_PAIR).names)

    def _candidates(self, pairs: DataFrame) -> DataFrame:
        """Pairs of different identities of one placement, with the flag of their boards: the same."""
        return pairs.filter("ident != old_ident").select(*PAIR, F.lit(True).alias("same_board"))

    def _near_candidates(self) -> DataFrame | None:
        """The pairs one character apart that were found since they were scored last, with their origins; none if there are none."""
        near = self.pairs.read(self.scored)
        total = near.count()
        if not total:
            return None
        for p in ("", "old_"):
            wanted = near.select(F.col(f"{p}ident").alias("key")).distinct()
            told = self.stores["ident"].probe(wanted).filter("found").select(F.col("key").alias(f"{p}ident"), *[F.col(f"old_{c}").alias(f"{p}{c}") for c in ORIGIN])
            load = near.groupBy(f"{p}ident").agg(F.count(F.lit(1)).alias("_n"))
            near = hot_join(near, told.join(load, f"{p}ident"), f"{p}ident", "_n", total).drop("_n")
        return near.select(*PAIR, F.lit(False).alias("same_board"))

    def _score_near(self) -> None:
        near = self._near_candidates()
        if near is not None:
            self.links.add(self._linked(near))
        self.scored = self.pairs.done

    def _linked(self, pairs: DataFrame) -> DataFrame:
        """Links of candidates above the threshold, the larger identity first."""
        score = self.weights.score(_agreement(F.col("same_board")))
        linked = pairs.select(F.greatest("ident", "old_ident").alias("ident"), F.least("ident", "old_ident").alias("rep"), score.alias("score"))
        return linked.filter(F.col("score") >= self.weights.limit(self.threshold))

    def _flush(self, fresh: DataFrame, shown: DataFrame, about: int, level: int = 0) -> tuple[DataFrame, DataFrame | None]:
        """Store new identities, newly shown placements and boards; gives the pairs among them by placement and by near key."""
        told = ["state", "game", "ply", "dump"]
        self.stores["ident"].flush(fresh.select(F.col("ident").alias("key"), "first", *told), level, compact=False, about=about)
        pairs = self._twins("place", shown.filter("place is not null").select(F.col("place").alias("key"), "ident", *told), level, about)
        return pairs, self._apart(self._twins("near", self._near_rows(shown), level, 4 * about)) if self.near else None

    def _twins(self, name: str, rows: DataFrame, level: int, about: int) -> DataFrame:
        store = self.stores[name]
        run = store.flush(rows, level, compact=False, about=about)
        if run is None:
            return self.spark.createDataFrame([], T.StructType([T.StructField(p + f.name, f.dataType) for p in ("", "old_") for f in store.schema.fields]))
        return store.twins(run)

    def _close_round(self) -> None:
        for name in ("ident", "place", "near"):
            self.stores[name].compact()
        self._commit()

    def start(self, history: DataFrame) -> DataFrame:
        """Take in the accepted records, learning the weights from them; gives (rec_id, ident) of those with an identity."""
        history = session.cut(history, "link-history")
        ids = session.cut(_identities(history, repeats=True), "link-ids")
        shown = session.cut(history.filter("ident is not null").select("rec_id", "ident"), "link-records")
        session.release(history)
        pairs, near = self._flush(ids, ids, ids.count(), level=1)
        pairs = self._candidates(pairs)
        if self.near:
            self.pairs.add(near)
            near = self._near_candidates()
            pairs = pairs.unionByName(near) if near is not None else pairs
            self.scored = self.pairs.done
        pairs = session.cut(pairs, "link-pairs")
        flags = _agreement(F.col("same_board"))
        counted = [(tuple(r[f] for f in FIELDS), r.c) for r in pairs.groupBy(*[flags[f].alias(f) for f in FIELDS]).agg(F.count(F.lit(1)).alias("c")).collect()]
        every = sum(c for _, c in counted)
        u = [(sum(c for f, c in counted if f[0]) + 1) / (every + 2)]
        state = F.split("state", " ")
        values = [*[F.get(state, F.lit(k)) for k in range(3)], *[F.col(c).cast("string") for c in ORIGIN]]
        told = ids.select(F.posexplode(F.array(*values)).alias("k", "v")).filter("v is not null").groupBy("k", "v").agg(F.count(F.lit(1)).cast("double").alias("c"))
        alike = {r.k: r.u for r in told.groupBy("k").agg((F.sum(F.col("c") ** 2) / F.sum("c") ** 2).alias("u")).collect()}
        u += [alike.get(k, 0.5) for k in range(len(values))]
        repeats = ids.agg(*[f(F.col(f"same_{c}")) for c in ORIGIN for f in (F.count_if, F.count)]).first()
        self.weights = learn_weights(counted, u, [(repeats[2 * k], repeats[2 * k + 1]) for k in range(len(ORIGIN))])
        self.links.add(self._linked(pairs))
        self._close_round()
        for df in (ids, pairs):
            session.release(df)
        return shown

    def add(self, batch: DataFrame, known: Rounds) -> None:
        """One batch; ``known`` gets KNOWN of its identities."""
        ids = _identities(batch).withColumnRenamed("ident", "key")
        seen = session.cut(self.stores["ident"].probe(ids), "link-probe")
        count = seen.count()
        named = seen.withColumnRenamed("key", "ident")
        fresh = named.filter("not found")
        # new identities, and those known by their key alone so far whose text arrives
        shown = named.filter("state is not null and (not found or old_state is null)").select("ident", "place", "board", "state", *ORIGIN)
        hits = self.stores["place"].probe(shown.filter("place is not null").withColumnRenamed("place", "key").drop("board")).filter("found")
        hits = session.cut(hits, "link-place")
        there = hits.filter("ident = old_ident").select("ident")  # its text came in an earlier round
        shown = shown.join(there, "ident", "left_anti")
        # both probes read the runs of before, whenever they are evaluated
        near = self._apart(self.stores["near"].probe(self._near_rows(shown)).filter("found")) if self.near else None
        pairs, within = self._flush(fresh, shown, about=count)
        if self.near:
            self.pairs.add(near.unionByName(within))
        pairs = hits.join(there, "ident", "left_anti").select(*pairs.columns).unionByName(pairs)
        self.links.add(self._linked(self._candidates(pairs)))
        earlier = F.col("old_first") < F.col("first")
        first = [F.when(earlier, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in ("first", "state", *ORIGIN)]
        known.add(named.select("ident", "n", *first))
        self._close_round()
        for df in (seen, hits):
            session.release(df)

    def repeats(self, records: DataFrame, firsts: DataFrame, total: int) -> DataFrame:
        """(rec_id, first_rec_id, ident, score) of records linked to the first record of their identity; each such identity is a link.

        ``firsts``: KNOWN, one row for each identity.
        """
        old = firsts.select("ident", "n", *[F.col(c).alias(f"old_{c}") for c in ("first", "state", *ORIGIN)])
        both = hot_join(records.select("rec_id", "ident", "state", *ORIGIN), old, "ident", "n", total).filter("rec_id > old_first")
        # what an equal identity does not show (a key alone) it shows all the same, since the digests are equal
        flags = _agreement(F.lit(True))
        flags |= {name: F.coalesce(flags[name], F.lit(True)) for name in SHOWN}
        scored = both.select("rec_id", F.col("old_first").alias("first_rec_id"), "ident", self.weights.score(flags).alias("score"))
        linked = session.cut(scored.filter(F.col("score") >= self.weights.limit(self.threshold)), "link-repeats")
        self.links.add(linked.groupBy("ident").agg(F.max("score").alias("score")).withColumn("rep", F.col("ident")))
        return linked

    def _roots(self, nodes: DataFrame) -> DataFrame:
        """(node, root) of ``nodes`` (node) by the stored mapping, followed to its end."""
        at = nodes.select("node", F.col("node").alias("root"))
        while True:
            probed = self.stores["reps"].probe(at.select(F.col("root").alias("key")).distinct())
            up = session.cut(probed.filter("found and old_rep != key").groupBy("key").agg(F.min("old_rep").alias("up")), "reps-up")
            if not up.count():
                return at
            at = session.cut(at.join(up, at.root == up.key, "left").select("node", F.coalesce("up", "root").alias("root")), "reps-at")

    def merge(self) -> None:
        """Union-find over the links that were made since the last merge: only the clusters they touch are updated.

        The near pairs of the rounds since are scored first, all at once.
        """
        self._score_near()
        if self.merged == self.links.done:
            return
        edges = self.links.read(self.merged).select("ident", "rep").distinct()
        edges = session.cut(edges, "merge-edges")
        if edges.count():
            nodes = session.cut(edges.select(F.col("ident").alias("node")).unionByName(edges.select(F.col("rep").alias("node"))).distinct(), "merge-nodes")
            roots = self._roots(nodes) if self.stores["reps"].runs else nodes.select("node", F.col("node").alias("root"))
            left = roots.select(F.col("node").alias("ident"), F.col("root").alias("a"))
            right = roots.select(F.col("node").alias("rep"), F.col("root").alias("b"))
            moved = components(edges.filter("ident != rep").join(left, "ident").join(right, "rep").select("a", "b"))
            # each touched node points to its new root at once, and so does each root that is none any more
            ends = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("_new")), "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
            new = ends.unionByName(moved.select("node", "root")).distinct()
            self.stores["reps"].flush(session.cut(new.select(F.col("node").alias("key"), F.col("root").alias("rep")), "merge-new"), compact=False)
            self.stores["reps"].compact()
        self.merged = self.links.done
        self._commit()

    def representatives(self) -> DataFrame:
        """(ident, rep) of every identity that is linked, be it to its repeats only."""
        self.merge()
        pairs = session.cut(self.stores["reps"].scan().groupBy("key").agg(F.min("rep").alias("rep")), "reps-stored")
        roots = components(pairs.filter("key != rep").select("key", "rep")).withColumnRenamed("node", "key")
        return pairs.join(roots, "key", "left").select(F.col("key").alias("ident"), F.coalesce("root", "rep").alias("rep"))


@dataclass
class Linked:
    """``links``: the scored links of different identities; ``idents``: the batches' identities with the number of their
    records; ``repeated``: (rec_id, first_rec_id, ident, score) of batch records linked to the first of their identity;
    ``records``: (rec_id, ident) of all records of history and batches, as given, that have an identity; ``reps``: the
    representatives (ident, rep) of linked identities.
    """

    linker: Linker
    idents: DataFrame
    repeated: DataFrame
    records: DataFrame
    reps: DataFrame

    @property
    def weights(self) -> Weights:
        return self.linker.weights

    @property
    def links(self) -> DataFrame:
        return self.linker.links.read().filter("ident != rep")

    @cached_property
    def found(self) -> DataFrame:
        """(first_rec_id, rec_id) of batch records that show what a record of smaller rec_id shows: linked, of one cluster, exactly equal."""
        classes = self.reps.join(self.idents, "ident")
        return hot_join(self.repeated, classes, "ident", "n", self.repeated.count()).select("first_rec_id", "rec_id")

    @cached_property
    def clusters(self) -> DataFrame:
        """(ident, rep): the near-duplicate class of every identity of the batches, named by its smallest identity."""
        return self.idents.join(self.reps, "ident", "left").select("ident", F.coalesce("rep", "ident").alias("rep"))

    @cached_property
    def members(self) -> DataFrame:
        """(rec_id, rep): the near-duplicate class of every record that has an identity."""
        moved = self.reps.filter("ident != rep")
        load = self.records.join(moved.select("ident"), "ident", "left_semi").groupBy("ident").agg(F.count(F.lit(1)).alias("n"))
        table = moved.join(load, "ident")
        both = hot_join(self.records, table, "ident", "n", self.records.count(), how="left")
        return both.select("rec_id", F.coalesce("rep", "ident").alias("rep"))


def link(
    history: DataFrame | None, batches: DataFrame, flush_batches: int = 4, threshold: float = 0.9, rows_per_file: int = 2_000_000, path: str | None = None, near: bool = True
) -> Linked:
    """Link ``batches`` (RECORD) against ``history`` (RECORD) and against the batches before them, batch by batch.

    ``flush_batches`` batches are taken in at a time; within them the order of rec_id tells which came first.
    ``threshold`` is the probability above which a pair is a near-duplicate. Exact answers do not depend on it, nor on
    ``near``, which adds the blocking keys of damaged boards. With the ``path`` of a linker begun before, its tables are
    the history and ``history`` is not read.
    """
    spark = batches.sparkSession
    # cut before the filter, for which the texts would be read twice
    batches = session.cut(batches, "link-batches").filter("ident is not null")
    linker = Linker(spark, path or session.new_path(spark, "linker"), rows_per_file, threshold, near)
    shown = batches.select("rec_id", "ident")
    if linker.state_is_new:
        shown = linker.start(history).unionByName(shown)
    known = Rounds(spark, session.new_path(spark, "link-rounds"), KNOWN)
    for low, high in rounds(batches, flush_batches):
        linker.add(batches.filter(F.col("rec_id").between(low, high)), known)
    told = F.struct("state", *ORIGIN)
    firsts = known.read().groupBy("ident").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min_by(told, "first").alias("_t"))
    firsts = session.cut(firsts.select("ident", "n", "first", "_t.*"), "link-firsts")
    repeated = linker.repeats(batches, firsts, batches.count())
    return Linked(linker, firsts.select("ident", "n"), repeated, shown, session.cut(linker.representatives(), "representatives"))
