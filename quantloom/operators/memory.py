"""Layered, scored, decaying memory.

A memory record is a row ``(symbol, layer, id, importance, recency, delta,
compound, access_counter, ...)``.  One memory step (decay, clean-up, two
rounds of promotions / demotions) is a pure function of the row and the
layer parameters, so it is a projection: no shuffle, no per-symbol state.
Parameters are a fixed four-row config; they are compiled into CASE
expressions (``params_df`` exposes them as a table too).

Several steps with exogenous feedback events (I11) fold the step function
over ``sequence(1, n)`` with ``aggregate`` - still one projection per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators.ordered import keep_first
from quantloom.sources.tables import md5_uniform


@dataclass(frozen=True)
class LayerParams:
    layer: str
    jump_lower: float | None      # below -> move one layer down (None = unbounded)
    jump_upper: float | None      # at or above -> move one layer up (None = unbounded)
    recency_factor: float
    importance_factor: float
    recency_threshold: float
    importance_threshold: float


# Layer parameters of the reference configuration, in layer order.
DEFAULT_PARAMS = (
    LayerParams("short", None, 60.0, 3.0, 0.92, 0.05, 5.0),
    LayerParams("mid", 60.0, 80.0, 90.0, 0.967, 0.05, 5.0),
    LayerParams("long", 80.0, None, 365.0, 0.988, 0.05, 5.0),
    LayerParams("reflection", None, None, 365.0, 0.988, 0.05, 5.0),
)
# Layers that take part in promotions / demotions, bottom to top.
JUMP_CHAIN = ("short", "mid", "long")
# Weighted importance draws per layer, as (score, probability).
IMPORTANCE_DRAWS = {
    "short": ((50.0, 0.5), (70.0, 0.45), (90.0, 0.05)),
    "mid": ((40.0, 0.05), (60.0, 0.8), (80.0, 0.15)),
    "long": ((40.0, 0.05), (60.0, 0.15), (80.0, 0.8)),
    "reflection": ((40.0, 0.05), (60.0, 0.15), (80.0, 0.8)),
}
IMPORTANCE_CAP = 100.0       # fixed value: importance is capped at 100 inside the compound score
ACCESS_STEP = 5.0            # fixed value: importance gain per access-counter unit
RECENCY_INIT = 1.0           # fixed value: initial recency
# Source type -> layer routing.
SOURCE_LAYER = {"news": "short", "10-Q": "mid", "10-K": "long", "reflection": "reflection"}


def params_df(spark: SparkSession, params=DEFAULT_PARAMS) -> DataFrame:
    """The layer parameter table."""
    rows = [(p.layer, p.jump_lower, p.jump_upper, p.recency_factor, p.importance_factor,
             p.recency_threshold, p.importance_threshold, i) for i, p in enumerate(params)]
    return spark.createDataFrame(rows, "layer string, jump_lower double, jump_upper double, "
                                       "recency_factor double, importance_factor double, "
                                       "recency_threshold double, importance_threshold double, priority int")


def _case(layer: Column, params, attr: str) -> Column:
    out = None
    for p in params:
        v = getattr(p, attr)
        lit = F.lit(v).cast("double")
        out = F.when(layer == p.layer, lit) if out is None else out.when(layer == p.layer, lit)
    return out


# ------------------------------------------------------------------ scalar rules

def compound_score(recency: Column, importance: Column) -> Column:
    """Recency + min(importance, 100) / 100."""
    return recency + F.least(importance, F.lit(IMPORTANCE_CAP)) / F.lit(100.0)


def merge_score(similarity: Column, compound: Column) -> Column:
    """Retrieval score."""
    return similarity + compound


def importance_draw(key: Column, layer: Column, seed: str = "42") -> Column:
    """Reproducible weighted draw of the initial importance per layer.

    An unknown layer raises inside the job (the reference raises too).
    """
    u = md5_uniform(key, seed)
    out = None
    for name, draws in IMPORTANCE_DRAWS.items():
        cum, ladder = 0.0, None
        for i, (score, prob) in enumerate(draws):
            cum = round(cum + prob, 10)
            if i == len(draws) - 1:
                ladder = ladder.otherwise(F.lit(score)) if ladder is not None else F.lit(score)
            else:
                ladder = (F.when(u < F.lit(cum), F.lit(score)) if ladder is None
                          else ladder.when(u < F.lit(cum), F.lit(score)))
        out = F.when(layer == name, ladder) if out is None else out.when(layer == name, ladder)
    return out.otherwise(F.raise_error(F.concat(F.lit("invalid memory layer: "), layer)).cast("double"))


# K5: importance initialisation strategies by name; each maps (key, layer) -> importance column.
IMPORTANCE_STRATEGIES = {"sample": importance_draw}


def importance_init(strategy: str = "sample"):
    """K5: the importance initialisation strategy; an unknown name is an error, as in the reference."""
    try:
        return IMPORTANCE_STRATEGIES[strategy]
    except KeyError:
        raise ValueError(f"invalid importance score initialization type: {strategy}") from None


def route_layer(source_type: Column) -> Column:
    """News -> short, 10-Q -> mid, 10-K -> long, reflection -> reflection."""
    out = None
    for src, layer in SOURCE_LAYER.items():
        out = F.when(source_type == src, F.lit(layer)) if out is None else out.when(source_type == src, F.lit(layer))
    return out


def init_memories(items: DataFrame, id_col: str = "id", layer_col: str = "layer", seed: str = "42") -> DataFrame:
    """New records with drawn importance, recency 1, delta 0, counter 0, compound.

    ``items`` carries (symbol, date, id, layer, ...); ``id`` must be unique
    (e.g. the source document id), so no global numbering is needed.
    """
    imp = importance_draw(F.col(id_col), F.col(layer_col), seed)
    return (items.withColumn("importance", imp)
            .withColumn("recency", F.lit(RECENCY_INIT))
            .withColumn("delta", F.lit(0))
            .withColumn("access_counter", F.lit(0))
            .withColumn("compound", compound_score(F.col("recency"), F.col("importance"))))


# ------------------------------------------------------------------ one step on a struct

def with_compound(mem: DataFrame) -> DataFrame:
    """Add the compound score to records that do not carry it yet."""
    return mem.withColumn("compound", compound_score(F.col("recency"), F.col("importance")))


def _state() -> Column:
    return F.struct(
        F.col("layer").alias("layer"), F.col("importance").cast("double").alias("importance"),
        F.col("recency").cast("double").alias("recency"), F.col("delta").cast("int").alias("delta"),
        F.col("compound").cast("double").alias("compound"), F.col("access_counter").cast("int").alias("access_counter"),
        F.lit(True).alias("alive"), F.lit(False).alias("jumped"), F.lit("").alias("transition"))


def _with(s: Column, **fields) -> Column:
    for k, v in fields.items():
        s = s.withField(k, v)
    return s


def feedback_on_state(s: Column, fb: Column, feedback_after_jump: bool = False) -> Column:
    """I4 on a live record: counter += fb; importance += 5 * counter; compound recomputed."""
    ok = s["alive"] & (F.lit(True) if feedback_after_jump else ~s["jumped"]) & fb.isNotNull() & (fb != 0)
    counter = s["access_counter"] + fb
    imp = s["importance"] + counter.cast("double") * F.lit(ACCESS_STEP)
    return F.when(ok, _with(s, access_counter=counter, importance=imp,
                            compound=compound_score(s["recency"], imp))).otherwise(s)


def _jump_table(params=DEFAULT_PARAMS):
    """Outcome of two rounds of short, mid, long jumps for every (layer, importance band).

    Jumps never change importance, so the outcome depends only on the start
    layer and on which band between the thresholds the importance lies in;
    the rounds are played out once here, in Python, on the band boundaries.
    Returns rows (layer, lo, hi, final_layer, went_up, jumped, transition).
    """
    by = {p.layer: p for p in params}
    chain = [c for c in JUMP_CHAIN if c in by]
    cuts = sorted({t for c in chain for t in (by[c].jump_lower, by[c].jump_upper) if t is not None})
    bands = [(None, cuts[0] if cuts else None)] + [
        (c, cuts[i + 1] if i + 1 < len(cuts) else None) for i, c in enumerate(cuts)]
    rows = []
    for layer in chain:
        for lo, hi in bands:
            v = (hi - 1.0) if lo is None else lo
            cur, up, path = layer, False, ""
            for _ in range(2):
                for i, name in enumerate(chain):
                    if cur != name:
                        continue
                    p = by[name]
                    if i + 1 < len(chain) and p.jump_upper is not None and v >= p.jump_upper:
                        cur, up, path = chain[i + 1], True, path + f"{name}>{chain[i + 1]};"
                    elif i > 0 and p.jump_lower is not None and v < p.jump_lower:
                        cur, path = chain[i - 1], path + f"{name}>{chain[i - 1]};"
            rows.append((layer, lo, hi, cur, up, bool(path), path))
    return rows


def _jump_columns(layer: Column, imp: Column, params=DEFAULT_PARAMS):
    """CASE expressions (final_layer, went_up, transition) from the jump table."""
    final = went_up = path = None
    for lyr, lo, hi, cur, up, _jumped, tr in _jump_table(params):
        cond = layer == lyr
        if lo is not None:
            cond = cond & (imp >= F.lit(lo))
        if hi is not None:
            cond = cond & (imp < F.lit(hi))
        final = F.when(cond, F.lit(cur)) if final is None else final.when(cond, F.lit(cur))
        went_up = F.when(cond, F.lit(up)) if went_up is None else went_up.when(cond, F.lit(up))
        path = F.when(cond, F.lit(tr)) if path is None else path.when(cond, F.lit(tr))
    return final.otherwise(layer), went_up.otherwise(F.lit(False)), path.otherwise(F.lit(""))


def _let(value: Column, fn) -> Column:
    """Bind ``value`` to a lambda variable once and build ``fn(variable)`` on it.

    Inside higher-order functions there is no common-subexpression elimination,
    so a state referenced several times is bound first instead of copied.
    """
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _x: acc, fn)


def _decay_state(s: Column, params=DEFAULT_PARAMS) -> Column:
    layer = s["layer"]
    delta = s["delta"] + 1
    rec = F.exp(-(delta.cast("double") / _case(layer, params, "recency_factor")))
    imp = s["importance"] * _case(layer, params, "importance_factor")
    dead = (rec < _case(layer, params, "recency_threshold")) | (imp < _case(layer, params, "importance_threshold"))
    return F.when(s["alive"], _with(s, delta=delta, recency=rec, importance=imp,
                                    compound=compound_score(rec, imp), alive=~dead)).otherwise(s)


def _jump_state(s: Column, params=DEFAULT_PARAMS) -> Column:
    final, up, path = _jump_columns(s["layer"], s["importance"], params)
    moved = s["alive"] & (path != "")
    return F.when(moved, _with(
        s, layer=final,
        recency=F.when(up, F.lit(RECENCY_INIT)).otherwise(s["recency"]),
        delta=F.when(up, F.lit(0)).otherwise(s["delta"]),
        jumped=F.lit(True), transition=F.concat(s["transition"], path))).otherwise(s)


def step_state(s: Column, params=DEFAULT_PARAMS) -> Column:
    """I7 + I10 on a struct: decay, clean-up, then two rounds of short, mid, long jumps."""
    return _let(_decay_state(s, params), lambda d: _jump_state(d, params))


def _unpack(df: DataFrame, col: str, keep) -> DataFrame:
    fields = ["layer", "importance", "recency", "delta", "compound", "access_counter", "alive", "jumped", "transition"]
    return df.select(*keep, *[F.col(f"{col}.{f}").alias(f) for f in fields])


def _keep_cols(df: DataFrame):
    state = {"layer", "importance", "recency", "delta", "compound", "access_counter"}
    return [c for c in df.columns if c not in state]


# ------------------------------------------------------------------ DataFrame operators

def decay(mem: DataFrame, params=DEFAULT_PARAMS) -> DataFrame:
    """Delta += 1, recency = exp(-delta / factor), importance *= factor, compound recomputed."""
    layer = F.col("layer")
    delta = F.col("delta") + 1
    rec = F.exp(-(delta.cast("double") / _case(layer, params, "recency_factor")))
    imp = F.col("importance") * _case(layer, params, "importance_factor")
    out = mem.withColumns({"delta": delta, "recency": rec, "importance": imp})
    return out.withColumn("compound", compound_score(F.col("recency"), F.col("importance")))


def cleanup_flag(mem: DataFrame, params=DEFAULT_PARAMS) -> DataFrame:
    """``removed`` when recency < threshold or importance < threshold."""
    layer = F.col("layer")
    dead = ((F.col("recency") < _case(layer, params, "recency_threshold"))
            | (F.col("importance") < _case(layer, params, "importance_threshold")))
    return mem.withColumn("removed", dead)


def cleanup(mem: DataFrame, params=DEFAULT_PARAMS) -> tuple[DataFrame, DataFrame]:
    """I6 split: (kept, removed)."""
    f = cleanup_flag(mem, params)
    return f.where(~F.col("removed")).drop("removed"), f.where(F.col("removed")).drop("removed")


def transitions(mem: DataFrame, params=DEFAULT_PARAMS) -> DataFrame:
    """I8 + I9 only (no decay): two rounds of promotions / demotions of live rows.

    Up moves reset recency to 1 and delta to 0; compound is not recomputed (Q7).
    """
    final, up, path = _jump_columns(F.col("layer"), F.col("importance"), params)
    return (mem.withColumn("_up", up).withColumn("transition", path)
               .withColumn("jumped", F.col("transition") != "")
               .withColumn("recency", F.when(F.col("_up"), F.lit(RECENCY_INIT)).otherwise(F.col("recency")))
               .withColumn("delta", F.when(F.col("_up"), F.lit(0)).otherwise(F.col("delta")))
               .withColumn("layer", final).drop("_up"))


def memory_step(mem: DataFrame, params=DEFAULT_PARAMS) -> DataFrame:
    """One full step for every record of every symbol and layer.

    Written as flat column expressions (decay, clean-up flag, then the jump
    table as CASE), so it stays inside whole-stage codegen.  Output keeps every
    row with ``alive`` (False = removed by clean-up), ``jumped`` and
    ``transition`` (e.g. 'short>mid;mid>long;').
    """
    layer = F.col("layer")
    d = mem.withColumns({
        "_delta1": F.col("delta") + 1,
        "_imp1": F.col("importance") * _case(layer, params, "importance_factor"),
    })
    d = d.withColumn("_rec1", F.exp(-(F.col("_delta1").cast("double") / _case(layer, params, "recency_factor"))))
    dead = ((F.col("_rec1") < _case(layer, params, "recency_threshold"))
            | (F.col("_imp1") < _case(layer, params, "importance_threshold")))
    d = d.withColumn("alive", ~dead)
    final, up, path = _jump_columns(layer, F.col("_imp1"), params)
    d = d.withColumns({"_final": final, "_up": F.col("alive") & up, "_path": F.when(F.col("alive"), path)
                       .otherwise(F.lit(""))})
    out = d.withColumns({
        "layer": F.when(F.col("alive"), F.col("_final")).otherwise(layer),
        "importance": F.col("_imp1"),
        "recency": F.when(F.col("_up"), F.lit(RECENCY_INIT)).otherwise(F.col("_rec1")),
        "delta": F.when(F.col("_up"), F.lit(0)).otherwise(F.col("_delta1")),
        "compound": compound_score(F.col("_rec1"), F.col("_imp1")),
        "access_counter": F.col("access_counter").cast("int"),
        "jumped": F.col("_path") != "",
        "transition": F.col("_path"),
    })
    return out.drop("_delta1", "_imp1", "_rec1", "_final", "_up", "_path")


def memory_lifecycle(mem: DataFrame, n_steps, events: DataFrame | None = None,
                     params=DEFAULT_PARAMS, feedback_after_jump: bool = False,
                     trace: bool = False) -> DataFrame:
    """I11 (+I12 with ``trace``): ``n_steps`` steps of each record with feedback events.

    ``n_steps`` is an int or a per-row integer column.  ``events`` = ([symbol,] id,
    step, feedback; matched on the symbol too when both sides have one): applied at the start of ``step`` (the replay updates access
    counters before the memory step of the day).  Every record folds its own
    events, so this is a per-row ``aggregate``; every intermediate state is
    bound once (``_let``) so nothing is evaluated twice inside the fold.
    """
    keep = _keep_cols(mem)
    ev_type = "array<struct<step:int,feedback:int>>"
    if events is not None:
        on = ["symbol", "id"] if "symbol" in events.columns and "symbol" in mem.columns else ["id"]
        ev = events.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("step", "feedback"))).alias("_ev"))
        mem = mem.join(ev, on, "left")
    else:
        mem = mem.withColumn("_ev", F.lit(None).cast(ev_type))
    init = _state()
    snap = F.array().cast("array<struct<step:int,layer:string,importance:double,recency:double,"
                          "compound:double,alive:boolean>>")
    acc0 = F.struct(init.alias("s"), snap.alias("trace"))

    def body(acc, k):
        evs = F.filter(F.coalesce(F.col("_ev"), F.array().cast(ev_type)), lambda e: e["step"] == k)
        fed = F.aggregate(evs, acc["s"], lambda st, e: feedback_on_state(st, e["feedback"], feedback_after_jump))

        def record(s3):
            if not trace:
                return F.struct(s3.alias("s"), acc["trace"].alias("trace"))
            entry = F.struct(k.alias("step"), s3["layer"].alias("layer"), s3["importance"].alias("importance"),
                             s3["recency"].alias("recency"), s3["compound"].alias("compound"),
                             s3["alive"].alias("alive"))
            return F.struct(s3.alias("s"), F.concat(acc["trace"], F.array(entry)).alias("trace"))
        return _let(fed, lambda sv: _let(step_state(sv, params), record))

    n = F.lit(n_steps) if isinstance(n_steps, int) else n_steps
    steps = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(steps, acc0, body)
    out = mem.withColumn("_acc", folded).withColumn("_s", F.col("_acc.s"))
    res = _unpack(out, "_s", [c for c in keep if c != "_ev"] + (["_acc"] if trace else []))
    if trace:
        res = res.withColumn("trace", F.col("_acc.trace")).drop("_acc")
    return res


def audit_rows(traced: DataFrame, keys=("symbol", "id")) -> DataFrame:
    """One snapshot row per (record, step) from a traced lifecycle."""
    return traced.select(*keys, F.explode("trace").alias("t")).select(*keys, "t.*")


# ------------------------------------------------------------------ feedback

def route_feedback(memories: DataFrame, cited: DataFrame, removed_ids: DataFrame | None = None) -> DataFrame:
    """Distinct cited ids applied in the first layer (short, mid, long, reflection) holding the id.

    ``cited`` = (symbol, cited_id, feedback, ...); ids in ``removed_ids`` (symbol, id) are ignored.
    Returns the cited rows with the target ``layer``; of repeated citations with different feedback
    the highest counts.
    """
    c = keep_first(cited, ["symbol", "cited_id"] + (["date"] if "date" in cited.columns else []),
                   [F.col("feedback").desc()])
    if removed_ids is not None:
        c = c.join(removed_ids.withColumnRenamed("id", "cited_id"), ["symbol", "cited_id"], "left_anti")
    prio = F.when(F.col("layer") == "short", 0).when(F.col("layer") == "mid", 1).when(
        F.col("layer") == "long", 2).otherwise(3)
    m = memories.select("symbol", F.col("id").alias("cited_id"), "layer").withColumn("_p", prio)
    j = c.join(m, ["symbol", "cited_id"])
    key = ["symbol", "cited_id"] + (["date"] if "date" in c.columns else [])
    w = Window.partitionBy(*key).orderBy("_p")
    return j.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_p")


def apply_feedback(memories: DataFrame, routed: DataFrame, order_cols=("date",)) -> DataFrame:
    """I4 for several events without decay in between.

    counter_j = counter_0 + f_1 + ... + f_j and importance gains 5 * counter_j
    at every event, so the final importance is importance_0 + 5 * sum_j counter_j
    (a running sum of running sums), compound recomputed once at the end.
    """
    ev = routed.select("symbol", F.col("cited_id").alias("id"), "layer", "feedback", *order_cols)
    ev = ev.where(F.col("feedback") != 0)
    w = Window.partitionBy("symbol", "layer", "id").orderBy(*order_cols)
    ev = ev.withColumn("_cum_fb", F.sum("feedback").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agg = ev.groupBy("symbol", "layer", "id").agg(
        F.sum("feedback").alias("_fb_total"), F.sum("_cum_fb").alias("_cum_total"), F.count(F.lit(1)).alias("_n_ev"))
    j = memories.join(agg, ["symbol", "layer", "id"], "left")
    has = F.col("_n_ev").isNotNull()
    counter = F.when(has, F.col("access_counter") + F.col("_fb_total")).otherwise(F.col("access_counter"))
    gain = (F.col("_n_ev") * F.col("access_counter") + F.col("_cum_total")).cast("double") * F.lit(ACCESS_STEP)
    imp = F.when(has, F.col("importance") + gain).otherwise(F.col("importance"))
    out = (j.withColumns({"access_counter": counter.cast("int"), "importance": imp, "updated": has})
            .withColumn("compound", F.when(F.col("updated"), compound_score(F.col("recency"), F.col("importance")))
                        .otherwise(F.col("compound"))))
    return out.drop("_fb_total", "_cum_total", "_n_ev")
