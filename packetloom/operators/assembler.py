"""Evidence packets under a hard budget: candidates with reasons and origins, atomic units, tiers, and a streamed fill.

Keys are computed by joins and aggregates; the fill itself is an ordered fold, so it streams over the sorted units of
all queries and holds one query's counters and what it put off. A unit is served whole or not at all; what is shortened
is labelled with its lines, and what is left out is named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.operators.closure import STATE_LATEST, TRUNCATED
from packetloom.runtime import cut, spread

PACKS = ("chrono", "bundle", "tiered", "evidence_first")
POLICIES = ("source_only", "carrier_only", "source_plus_carrier")
NO_RANK = 1 << 30
#: class of an edge by which an event was reached; the packs by evidence also know lists given by an oracle
EDGE_CLASS = {"DEPENDS_ON": 0, "RESULT_OF": 0, "GROUNDED_IN": 0, "SUPERSEDES": 1, "MATERIALIZES": 2}
QUOTE_CHARS = 20  #: a quoted line shorter than this proves nothing
EXCERPT_LINES, EXCERPT_CONTEXT, EXCERPT_MOST = 4, 2, 12


@dataclass(frozen=True)
class Packing:
    """How a packet is filled; the defaults are the plain packer, ``RECALL`` and ``RECIPE`` below are presets."""

    pack: str = "chrono"
    policy: str = "source_only"
    order: str = "chronological"  # or seed_first
    separator: str = "\n\n"
    header: str = ""
    evidence_hops: int = 2
    evidence_share: float = 1.0
    unit_cap_share: float | None = 0.8
    cost_order: bool = True
    excerpt: bool = True
    declare_omissions: bool = False

    def __post_init__(self) -> None:
        if self.pack not in PACKS or self.policy not in POLICIES or self.order not in ("chronological", "seed_first"):
            raise ValueError(f"unknown pack, policy or order in {self}")
        if self.evidence_hops < 0 or not 0 <= self.evidence_share <= 1 or not (self.unit_cap_share is None or 0 < self.unit_cap_share <= 1):
            raise ValueError(f"hops or shares out of range in {self}")

    @property
    def by_evidence(self) -> bool:
        return self.pack in ("tiered", "evidence_first")


#: named presets of the experiments
PRESETS = {"chrono": Packing(), "evidence_first": Packing(pack="evidence_first", evidence_share=0.5, excerpt=False), "evidence_first_x": Packing(pack="evidence_first", evidence_share=0.5)}


def header_tokens(text: str) -> int:
    """An estimate that errs upwards: words, or a third of the letters."""
    return max(1, len(text.split()), (len(text) + 2) // 3) if text else 0


# --- excerpts ---------------------------------------------------------------------------------------------------------


def line_scores(lines: list[str], terms: set[str], quotes: list[str]) -> list[int]:
    """Terms of the query in a line, 3 more for a line of 20 or more letters that a dependent quotes; the first counts."""
    out = []
    for i, line in enumerate(lines):
        low, bare = line.lower(), line.strip()
        score = sum(t in low for t in terms) + (3 if len(bare) >= QUOTE_CHARS and any(bare in q for q in quotes) else 0)
        out.append(max(score, 1) if i == 0 else score)
    return out


def excerpts(text: str, terms: set[str], quotes: list[str]) -> list[tuple[str, str, int]]:
    """(label, text, cost) of up to two shorter forms: scored lines with two around, and the twelve best alone."""
    lines = text.split("\n")
    if len(lines) < EXCERPT_LINES:
        return []
    scores, whole, out = line_scores(lines, terms, quotes), header_tokens(text), []
    for around, most in ((EXCERPT_CONTEXT, None), (0, EXCERPT_MOST)):
        hits = [i for i, s in enumerate(scores) if s > 0]
        if most is not None:
            hits = sorted(sorted(hits, key=lambda i: (-scores[i], i))[:most])
        shown = sorted({j for i in hits for j in range(max(0, i - around), min(len(lines), i + around + 1))})
        if not shown:
            continue
        runs = [[shown[0], shown[0]]]
        for j in shown[1:]:
            if j == runs[-1][1] + 1:
                runs[-1][1] = j
            else:
                runs.append([j, j])
        named = ",".join(str(a + 1) if a == b else f"{a + 1}-{b + 1}" for a, b in runs)
        body = "\n...\n".join("\n".join(lines[a:b + 1]) for a, b in runs)
        body = f"[excerpt: lines {named} of {len(lines)}]\n{body}"
        if header_tokens(body) < whole and all(body != b for _, b, _ in out):
            out.append((f"excerpt[{named}/{len(lines)}]", body, header_tokens(body)))
    return out


def _variants(policy: str, excerpt: bool, separator: str):
    """Forms of an event, richest first: (kind, text, cost)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = []
            for text, cost, car, car_cost, terms, quotes in zip(*[b.column(c).to_pylist() for c in ("text", "cost", "carrier_text", "carrier_cost", "terms", "quotes")]):
                text, cost = text or "", cost or 0
                whole, short = ("raw_text", text, cost), ("materialized_text", car, car_cost or 0)
                if car is None or policy == "source_only":
                    own = [whole]
                elif policy == "carrier_only":
                    own = [short]
                else:
                    own = [("raw_text+materialized_text", text + separator + car, cost + short[2]), whole]
                if excerpt and policy != "carrier_only":
                    own += [x for x in excerpts(text, set(terms or ()), [q for q in quotes or () if q]) if x[2] < cost]
                forms.append([{"kind": k, "text": t, "cost": c} for k, t, c in own])
            keep = [b.column(c) for c in ("query_id", "event_id")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(forms, _FORMS), pa.array([[x["cost"] for x in f] for f in forms], pa.list_(pa.int64()))], names=["query_id", "event_id", "forms", "costs"])

    return run


_FORMS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("cost", pa.int64())]))


# --- candidates -------------------------------------------------------------------------------------------------------


def best_seeds(seeds: DataFrame) -> DataFrame:
    """One seed an event: pinned, then the best rank, then the source's name. Equal rows count once."""
    s = seeds.groupBy("query_id", "event_id").agg(F.min(F.struct((~F.col("pinned")).alias("loose"), "rank", "source")).alias("s"))
    return s.select("query_id", "event_id", (~F.col("s.loose")).alias("pinned"), F.col("s.rank").cast("long").alias("seed_rank"), F.col("s.source").alias("source"))


def origins(best: DataFrame, steps: DataFrame, oracle_class: bool, rounds: int = 32) -> DataFrame:
    """(query_id, event_id, origin): best (seed rank, worst edge class on the way, hops) by which an event was reached.

    Labels spread from the seeds over the steps in rounds; a label that improves is passed on in the next one.
    """
    classes = {**EDGE_CLASS, **({"ORACLE": 0} if oracle_class else {})}
    cls = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), F.col("edge_type")), F.lit(3))
    arcs = cut(steps.filter(F.col("rule") != STATE_LATEST).select("query_id", F.col("child_id").alias("event_id"), "parent_id", cls.alias("cls")).distinct())
    label = lambda r, c, h: F.struct(r.cast("long").alias("r"), c.cast("int").alias("c"), h.cast("int").alias("h"))
    known = cut(best.select("query_id", "event_id", label(F.col("seed_rank"), F.lit(0), F.lit(0)).alias("origin")))
    fresh = known
    for _ in range(rounds):
        sent = fresh.join(arcs, ["query_id", "event_id"]).select("query_id", F.col("parent_id").alias("event_id"), label(F.col("origin.r"), F.greatest("origin.c", "cls"), F.col("origin.h") + 1).alias("got"))
        sent = sent.groupBy("query_id", "event_id").agg(F.min("got").alias("got")).join(known, ["query_id", "event_id"], "left").filter(F.col("origin").isNull() | (F.col("got") < F.col("origin")))
        fresh = cut(sent.select("query_id", "event_id", F.col("got").alias("origin")))
        if fresh.isEmpty():
            break
        known = cut(known.join(fresh.select("query_id", "event_id"), ["query_id", "event_id"], "left_anti").unionByName(fresh))
    return known


def candidates(nodes: DataFrame, steps: DataFrame, seeds: DataFrame, ev: DataFrame) -> DataFrame:
    """Closure nodes with seed rank, pin and the reason why they are there; of two reasons the stronger one stands."""
    best = best_seeds(seeds)
    reached = steps.groupBy("query_id", F.col("parent_id").alias("event_id")).agg(F.min(F.struct("wave", "hop", "edge_type")).alias("s")).select("query_id", "event_id", F.col("s.edge_type").alias("reached_by"))
    old = steps.filter(F.col("rule") == STATE_LATEST).select("query_id", F.col("child_id").alias("event_id"), F.lit(True).alias("old")).distinct()
    key = ["query_id", "event_id"]
    d = nodes.select("query_id", "session_id", "event_id", (F.col("tier") == "required").alias("required"))
    d = d.join(best, key, "left").join(reached, key, "left").join(old, key, "left").join(ev.select("session_id", "event_id", F.col("ts").alias("at"), "atomic_group"), ["session_id", "event_id"])
    d = d.withColumn("seed_rank", F.coalesce("seed_rank", F.lit(NO_RANK).cast("long"))).withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("query_id", "required").orderBy("seed_rank", "at", "event_id")) - 1
    reason = (
        F.when(F.coalesce("old", F.lit(False)) & ~F.col("required"), "superseded:demoted").when(F.col("source").isNotNull(), F.concat(F.lit("seed:"), "source"))
        .when(F.col("reached_by").isNotNull(), F.concat(F.lit("closure:"), "reached_by")).when(~F.col("required"), F.concat(F.lit("optional:"), place)).otherwise("closure:required")
    )
    return d.withColumn("reason", reason).drop("old", "reached_by")


def units(cand: DataFrame, origin: DataFrame, costs: DataFrame, p: Packing) -> DataFrame:
    """Candidates with their unit (atomic group, else the event) and the unit's place in the fill."""
    key = ["query_id", "event_id"]
    d = cand.join(origin, key, "left").join(costs, key)
    d = d.withColumn("unit", F.coalesce(F.concat(F.lit("g:"), "atomic_group"), F.concat(F.lit("e:"), "event_id")))
    o, seed = F.col("origin"), F.col("seed_rank") < NO_RANK
    k4 = lambda a, b, c, e: F.struct(*[x.cast("long").alias(n) for n, x in zip("abcd", (a, b, c, e))])
    zero = F.lit(0)
    strong = F.coalesce(o["r"] < NO_RANK, F.lit(False)) & (o["c"] <= 1) & (o["h"] <= p.evidence_hops) & (o["h"] > 0)
    weak = F.when(F.coalesce(o["r"] < NO_RANK, F.lit(False)), o["h"]).otherwise(99)
    if p.pack == "tiered":
        own = F.when(seed, k4(F.lit(1), F.col("seed_rank"), zero, zero)).when(strong, k4(F.lit(1), o["r"], o["h"], o["c"])).otherwise(k4(F.lit(2), weak, zero, zero))
    elif p.pack == "evidence_first":
        own = F.when(strong, k4(F.lit(1), o["r"], o["h"], o["c"])).when(seed, k4(F.lit(2), F.col("seed_rank"), zero, zero)).otherwise(k4(F.lit(3), weak, zero, zero))
    elif p.pack == "bundle":
        own = k4(F.lit(1), F.coalesce(o["r"], F.lit(NO_RANK)), F.coalesce(o["c"], F.lit(9)), F.coalesce(o["h"], F.lit(99)))
    else:
        own = k4(F.lit(1), F.col("seed_rank"), zero, zero)
    u = d.withColumn("own", own).groupBy("query_id", "unit").agg(
        F.max("required").alias("u_required"), F.max("pinned").alias("u_pinned"), F.min("seed_rank").alias("u_rank"), F.min("own").alias("k"), F.min(F.struct("at", "event_id")).alias("first"), F.min("at").alias("u_at"),
        F.collect_list("costs").alias("all"), F.count("*").alias("members"),
    )
    tiers = F.array_max(F.transform("all", lambda x: F.size(x)))
    cheapest = F.array_min(F.transform(F.sequence(F.lit(1), tiers), lambda t: F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + F.element_at(x, F.least(t, F.size(x))))))
    k = F.when(F.col("u_pinned"), k4(zero, F.col("u_rank") if p.pack != "bundle" else F.col("k.b"), zero if p.pack != "bundle" else F.col("k.c"), zero if p.pack != "bundle" else F.col("k.d"))).otherwise(F.col("k"))
    u = u.withColumn("k", k).withColumn("least", cheapest)
    by_cost = F.col("least") if p.cost_order and p.by_evidence else F.lit(0).cast("long")
    evidence = (F.col("k.a") == 1) & ~F.col("u_pinned") & (F.col("u_rank") >= NO_RANK) if p.by_evidence else F.lit(False)
    u = u.select("query_id", "unit", "u_required", "members", "least", evidence.alias("evidence"), F.struct(F.col("k.a").alias("tier"), by_cost.alias("cost"), F.col("k.b").alias("b"), F.col("k.c").alias("c"), F.col("k.d").alias("d"), F.col("u_at").alias("t"), F.col("first.event_id").alias("i"), "unit").alias("place"))
    return d.join(u, ["query_id", "unit"])


# --- the fill ---------------------------------------------------------------------------------------------------------
_FILLED = "query_id string, event_id string, form int"
_ROW = ("query_id", "event_id", "unit", "tier", "u_required", "evidence", "least", "costs", "budget")


class _Fill:
    """One query's fill. Units come in order; ``out`` gets (query, event, form), form -1 for what is left out."""

    def __init__(self, query: str, budget: int, header: int, p: Packing):
        self.query, self.p, self.left = query, p, budget - (header if header <= budget else 0)
        self.cap = round(p.unit_cap_share * budget) if p.by_evidence and p.unit_cap_share is not None else None
        self.share = round(p.evidence_share * budget) if p.by_evidence and p.evidence_share < 1 else None
        self.weak = 2 if p.pack == "tiered" else 3
        self.used, self.later, self.held, self.strong, self.out = 0, [], [], True, []

    def give(self, members, limit: int) -> int | None:
        """Serve a unit in the richest form, the same for all members, within ``limit``; its cost, or None."""
        for t in range(max(len(c) for _, c in members)):
            forms = [min(t, len(c) - 1) for _, c in members]
            cost = sum(c[f] for (_, c), f in zip(members, forms))
            if cost <= limit:
                self.out += [(self.query, e, f) for (e, _), f in zip(members, forms)]
                self.left -= cost
                return cost
        return None

    def attempt(self, members) -> int | None:
        limit = self.left if self.cap is None else min(self.left, self.cap)
        cost = self.give(members, limit)
        if cost is None:
            if limit < self.left:
                self.held.append(members)
            else:
                self.miss(members)
        return cost

    def miss(self, members) -> None:
        self.out += [(self.query, e, -1) for e, _ in members]

    def unit(self, members, tier: int, required: bool, evidence: bool, least: int) -> None:
        if self.strong and self.share is not None and (not required or tier >= self.weak):
            self.flush()
        if self.strong and self.share is not None and evidence and self.used + least > self.share:
            self.later.append(members)
            return
        cost = self.attempt(members)
        if cost and evidence:
            self.used += cost

    def flush(self) -> None:
        """Evidence beyond its share comes behind the seeds and before what was reached over weak edges only."""
        self.strong = False
        for members in self.later:
            self.attempt(members)
        self.later = []

    def end(self) -> list:
        self.flush()
        for members in self.held:
            if self.give(members, self.left) is None:
                self.miss(members)
        return self.out


def _fill(p: Packing):
    header = header_tokens(p.header)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill, unit, held = None, None, []
        for b in batches:
            done: list = []
            for q, e, u, tier, required, evidence, least, costs, budget in zip(*[b.column(c).to_pylist() for c in _ROW]):
                if held and (q, u) != unit:
                    fill.unit(*held)
                    held = []
                if fill is None or q != fill.query:
                    done += fill.end() if fill else []
                    fill = _Fill(q, budget, header, p)
                if not held:
                    held, unit = [[], tier, required, evidence, least], (q, u)
                held[0].append((e, costs))
            done += fill.out if fill else []
            if fill:
                fill.out = []
            if done:
                yield _filled(done)
        if fill:
            if held:
                fill.unit(*held)
            yield _filled(fill.end())

    return run


def _filled(rows: list) -> pa.RecordBatch:
    q, e, f = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(e, pa.string()), pa.array(f, pa.int32())], names=["query_id", "event_id", "form"])


def assemble(queries: DataFrame, seeds: DataFrame, nodes: DataFrame, steps: DataFrame, ev: DataFrame, p: Packing = Packing()) -> tuple[DataFrame, DataFrame]:
    """(entries, packets).

    ``queries``: query_id, session_id, query, query_mode, budget. ``seeds``: query_id, event_id, rank, source, pinned.
    ``nodes`` and ``steps`` of ``closure.close``. ``ev``: session_id, event_id, ts, text, cost, atomic_group and, where
    there are shorter witnesses, carrier_text and carrier_cost.

    entries: query_id, event_id, required, reason, form (its kind; null for what is left out), token_cost, text.
    packets: query_id, total_tokens, n_entries, incomplete, missing_required, omitted_optional, context, digest, one for
    every query, also without entries. The total never exceeds the budget.
    """
    key = ["query_id", "event_id"]
    q = cut(queries.select("query_id", "query", "query_mode", F.greatest(F.col("budget").cast("long"), F.lit(0)).alias("budget")))
    cand = cut(candidates(nodes, steps, seeds, ev))
    texts = ev.select("session_id", "event_id", "text", F.col("cost").cast("long").alias("cost"), *[(F.col(c) if c in ev.columns else F.lit(None)).cast(t).alias(c) for c, t in (("carrier_text", "string"), ("carrier_cost", "long"))])
    none = F.array().cast("array<string>")
    rows = cand.select("query_id", "session_id", "event_id").join(texts, ["session_id", "event_id"])
    if p.excerpt:
        dependents = steps.filter("edge_type = 'DEPENDS_ON' and child_id <> '' and child_id <> parent_id").select("query_id", F.col("parent_id").alias("event_id"), F.col("child_id").alias("quoting")).distinct()
        quoting = cand.select("query_id", "session_id", F.col("event_id").alias("quoting")).join(texts.select("session_id", F.col("event_id").alias("quoting"), F.col("text").alias("said")), ["session_id", "quoting"])
        quotes = dependents.join(quoting, ["query_id", "quoting"]).groupBy(*key).agg(F.collect_list("said").alias("quotes"))
        rows = rows.join(quotes, key, "left").join(q.select("query_id", T.query_terms(F.coalesce("query", F.lit(""))).alias("terms")), "query_id")
    else:
        rows = rows.withColumn("quotes", none).withColumn("terms", none)
    forms = cut(rows.select(*key, "text", "cost", "carrier_text", "carrier_cost", "terms", F.coalesce("quotes", none).alias("quotes")).mapInArrow(_variants(p.policy, p.excerpt, p.separator), "query_id string, event_id string, forms array<struct<kind:string,text:string,cost:bigint>>, costs array<bigint>"))
    best = best_seeds(seeds).join(cand.select(*key), key, "left_semi")
    placed = units(cand, origins(best, steps, p.by_evidence), forms.select(*key, "costs"), p)
    placed = placed.join(q.select("query_id", "budget"), "query_id").select(*key, "unit", F.col("place.tier").cast("int").alias("tier"), "u_required", "evidence", "least", "costs", "budget", "place", "at")
    ordered = spread(placed, "query_id").sortWithinPartitions("query_id", F.desc("u_required"), "place", "at", "event_id").select(*_ROW)
    filled = cut(ordered.mapInArrow(_fill(p), _FILLED))
    entries = filled.join(cand, key).join(forms.select(*key, "forms"), key).withColumn("f", F.get("forms", F.col("form")))
    entries = cut(entries.select("query_id", "event_id", "required", "reason", "seed_rank", "pinned", "at", F.when(F.col("form") >= 0, F.col("f.kind")).alias("form"), F.when(F.col("form") >= 0, F.col("f.cost")).alias("token_cost"), F.when(F.col("form") >= 0, F.col("f.text")).alias("text")))
    return entries.drop("seed_rank", "pinned", "at"), packets(q, entries, steps, p)


def packets(q: DataFrame, entries: DataFrame, steps: DataFrame, p: Packing) -> DataFrame:
    """One packet a query from its entries; served texts are bounded by the budget."""
    seeded = F.when(F.col("seed_rank") < NO_RANK, 0).otherwise(1)
    at = F.struct("at", "event_id") if p.order == "chronological" else F.struct(seeded.alias("s"), (~F.col("pinned")).alias("n"), "seed_rank", "at", "event_id")
    served = entries.filter("form is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("o"), "event_id", "form", "token_cost", "reason", "text"))).alias("e"), F.sum("token_cost").alias("tokens"))
    left = entries.filter("form is null").groupBy("query_id").agg(F.collect_set(F.when(F.col("required"), F.col("event_id"))).alias("missing"), F.array_sort(F.collect_set(F.when(~F.col("required"), F.col("event_id")))).alias("omitted"))
    ahead = steps.filter(F.col("rule") == TRUNCATED).select("query_id", F.col("parent_id").alias("event_id")).distinct().join(entries.filter("form is not null").select("query_id", "event_id"), ["query_id", "event_id"], "left_anti").groupBy("query_id").agg(F.collect_set("event_id").alias("ahead"))
    none = F.array().cast("array<string>")
    d = q.join(served, "query_id", "left").join(left, "query_id", "left").join(ahead, "query_id", "left")
    missing = F.array_sort(F.array_union(F.coalesce("missing", none), F.coalesce("ahead", none)))
    head = header_tokens(p.header)
    dropped = F.lit(head) > F.col("budget")
    body = F.array_join(F.transform("e", lambda x: x["text"]), p.separator)
    context = F.coalesce(body, F.lit(""))
    if p.header:
        context = F.when(dropped, context).when(context == "", p.header).otherwise(F.concat(F.lit(p.header + p.separator), context))
    total = F.coalesce("tokens", F.lit(0)) + F.when(dropped, 0).otherwise(head)
    d = d.withColumns({"missing_required": missing, "omitted_optional": F.coalesce("omitted", none), "context": context, "total_tokens": total.cast("long"), "dropped": dropped})
    if p.declare_omissions:
        names = F.array_join(F.slice("missing_required", 1, 8), ", ")
        note = F.concat(F.lit("[omitted] left out for the budget though required: "), F.size("missing_required"), F.lit(" record(s), "), names, F.when(F.size("missing_required") > 8, ", …").otherwise(""))
        d = d.withColumn("note", note).withColumn("note_cost", T.tokens_packet(F.col("note")).cast("long"))
        fits = (F.size("missing_required") > 0) & (F.col("total_tokens") + F.col("note_cost") <= F.col("budget"))
        d = d.withColumn("context", F.when(fits, F.concat("context", F.when(F.col("context") == "", "").otherwise(p.separator), "note")).otherwise(F.col("context"))).withColumn("total_tokens", F.when(fits, F.col("total_tokens") + F.col("note_cost")).otherwise(F.col("total_tokens")))
    manifest = F.transform(F.coalesce("e", F.array().cast(served.schema["e"].dataType.simpleString())), lambda x: F.concat_ws("|", x["event_id"], x["form"], x["token_cost"].cast("string"), x["reason"]))
    digest = F.sha2(F.concat_ws("\n", "query", "query_mode", F.col("budget").cast("string"), F.array_join(manifest, "\n"), F.array_join("missing_required", ",")), 256)
    return d.select("query_id", "total_tokens", F.coalesce(F.size("e"), F.lit(0)).alias("n_entries"), ((F.size("missing_required") > 0) | F.col("dropped")).alias("incomplete"), "missing_required", "omitted_optional", "context", digest.alias("digest"))
