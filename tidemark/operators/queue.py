"""Queues: pools of scored albums mixed into one short list."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import first_per, numbered_top, top_per


def compose(scored: DataFrame, shares: dict[str, int], n: int) -> DataFrame:
    """n places: pools in the order of shares, each with at most its share, one album per artist, best score first.

    scored: item, artist, pool, score. An artist's best pool (then score, then least item) is the one that counts. Every
    pool is cut to its share by a distributed top-k, so what is numbered last is at most the sum of the shares.
    """
    order = F.create_map(*(F.lit(x) for i, pool in enumerate(shares) for x in (pool, i)))
    placed = scored.withColumn("_pool", order[F.col("pool")]).where("_pool is not null")
    single = first_per(placed, ["artist"], F.asc("_pool"), F.desc("score"), F.asc("item"))
    cut = None
    for i, share in enumerate(shares.values()):
        part = single.where(F.col("_pool") == i).orderBy(F.desc("score"), F.asc("item")).limit(share)
        cut = part if cut is None else cut.unionByName(part)
    return numbered_top(cut, n, F.asc("_pool"), F.desc("score"), F.asc("item")).drop("_pool")


def interleave(scored: DataFrame, pools: list[str], n: int) -> DataFrame:
    """n places taken from pools in turn, the best of each first."""
    w = Window.partitionBy("pool").orderBy(F.desc("score"), F.asc("item"))
    turn = scored.where(F.col("pool").isin(pools)).withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= n)
    order = F.create_map(*(F.lit(x) for i, pool in enumerate(pools) for x in (pool, i)))
    return numbered_top(turn, n, F.asc("_turn"), order[F.col("pool")].asc()).drop("_turn")


#: Kinds of offers in the order in which a queue takes them, and the slot that each fills.
PIN, REVISIT, THREAD, BREAKER, NEW = "pin", "revisit", "thread", "breaker", "new"


def _draw(seed: int, *what) -> float:
    """A number in [0, 1) that seed and what decide."""
    return int.from_bytes(hashlib.sha256(repr((seed, *what)).encode()).digest()[:7], "big") / (1 << 56)


class _Builder:
    """One queue being built: an album once, an artist once (pins aside)."""

    def __init__(self):
        self.items, self.artists, self.chosen = set(), set(), []

    def fits(self, offer) -> bool:
        return offer.item not in self.items and offer.artist not in self.artists

    def take(self, offer, slot: str, artist_rule: bool = True) -> None:
        self.items.add(offer.item)
        if artist_rule:
            self.artists.add(offer.artist)
        self.chosen.append((slot, offer))

    def in_turns(self, lanes: list[list], slots: int, slot: str) -> int:
        """Lanes take turns, each giving its next offer that fits; empty lanes drop out."""
        lanes, taken = [iter(lane) for lane in lanes], 0
        while lanes and taken < slots:
            for lane in list(lanes):
                if taken == slots:
                    break
                offer = next((o for o in lane if self.fits(o)), None)
                if offer is None:
                    lanes.remove(lane)
                else:
                    self.take(offer, slot)
                    taken += 1
        return taken


def build_one(offers: list, n: int, revisit_share: float, threads: int, breakers: int, wildcards: int, wild_ranks: tuple[int, int], seed: int) -> list[tuple[str, object]]:
    """A queue of n places from one owner's offers (kind, lane, place, item, artist): (slot, offer), in order.

    Pins come first and block no artist. Then revisits from their pools in turn, up to their share; threads, lane by lane in
    turn; breakers; wildcards, drawn among the new ones of some ranks, if there are no pins; the rest is new ones by rank. In
    the end pins stay first and the kinds are mixed in an order that the seed draws, each kind in its own order.
    """
    by_kind: dict[str, dict[str, list]] = {}
    for o in sorted(offers, key=lambda o: (o.lane, o.place, o.item)):
        by_kind.setdefault(o.kind, {}).setdefault(o.lane, []).append(o)
    lanes = lambda kind: [*by_kind.get(kind, {}).values()]
    flat = lambda kind: [o for lane in lanes(kind) for o in lane]
    q = _Builder()
    pins = flat(PIN)[:n]
    for o in pins:
        q.take(o, "pinned", artist_rule=False)
    free = n - len(pins)
    free -= q.in_turns(lanes(REVISIT), min(round(n * revisit_share), free), "revisit")
    free -= q.in_turns(lanes(THREAD), min(threads, free), "thread")
    free -= q.in_turns([flat(BREAKER)], min(breakers, free), "tastebreaker")
    new = flat(NEW)
    for i in range(0 if pins else min(wildcards, free)):
        deep = [o for o in new if wild_ranks[0] <= o.place <= wild_ranks[1] and q.fits(o)]
        if deep:
            q.take(deep[int(_draw(seed, "wild", i) * len(deep))], "wildcard")
            free -= 1
    q.in_turns([new], free, "new")
    slots = [slot for slot, _ in q.chosen if slot != "pinned"]
    mixed = sorted(range(len(slots)), key=lambda i: _draw(seed, "mix", i))
    left = {slot: iter([o for s, o in q.chosen if s == slot]) for slot in set(slots)}
    # Each kind's own order: the i-th place of a kind goes to its i-th offer.
    return [(s, o) for s, o in q.chosen if s == "pinned"] + [(slots[i], next(left[slots[i]])) for i in mixed]


def build_queues(offers: DataFrame, n: int, *, revisit_share: float = 0.3, threads: int = 0, breakers: int = 0, wildcards: int = 0, wild_ranks: tuple[int, int] = (50, 300), seed: int = 0) -> DataFrame:
    """owner, place, slot, item, artist: a queue for every owner, each in a task of its own, from what could be taken at all.

    offers: owner, kind, lane (pool of a revisit, finished album of a thread), place (rank in its lane), item, artist. n places
    pass over at most n albums and n artists, so of a lane only the first n + 1 albums of each of its first 2 n + 1 artists
    can be reached; the cut is exact, and made before owners are dealt out. New ones of wildcard ranks are kept besides.
    """
    lane = ["owner", "kind", "lane"]
    clean = offers.select("owner", "kind", F.coalesce(F.col("lane").cast("string"), F.lit("")).alias("lane"), F.col("place").cast("long").alias("place"), F.col("item").cast("long").alias("item"), F.col("artist").cast("long").alias("artist"))
    firsts = clean.groupBy(*lane, "artist").agg(F.min(F.struct("place", "item")).alias("first"))
    near = top_per(firsts, lane, 2 * n + 1, F.asc("first")).drop("rank", "first")
    reached = top_per(clean.join(near, [*lane, "artist"]), [*lane, "artist"], n + 1, F.asc("place"), F.asc("item")).drop("rank")
    wild = clean.where((F.col("kind") == NEW) & F.col("place").between(*wild_ranks)) if wildcards else clean.limit(0)
    kept_offers = reached.unionByName(wild.select(*reached.columns)).distinct()
    kind = offers.schema["owner"].dataType.simpleString()

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        built = build_one([*rows.itertuples(index=False)], n, revisit_share, threads, breakers, wildcards, wild_ranks, seed)
        return pd.DataFrame([(key[0], i, slot, o.item, o.artist) for i, (slot, o) in enumerate(built, 1)], columns=["owner", "place", "slot", "item", "artist"])

    return kept_offers.groupBy("owner").applyInPandas(one, f"owner {kind}, place int, slot string, item long, artist long")
