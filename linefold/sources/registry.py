"""Registry of learned command shapes, folded from a call log.

Learning is a state machine over the calls of a command, in order: (shape, confidence).
A command of any length is folded in segments: the first one starts from a known state, each
later one becomes a function of its unknown start state, in a task of its own, and the functions
of a command are then applied one after the other. Confidences are doubles in [0.5, 1], all
multiples of 2^-53, so a function can add up its gains and losses exactly in these units.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import number_lines

# First confidence, gain, loss, thresholds and call counts of the learning rule.
INITIAL = 0.50
GAIN = 0.08
LOSS = 0.20
WARM = 0.65
HOT = 0.85
LOCKED = 0.95
WARM_CALLS = 3
HOT_CALLS = 10

# In units of 2^-53 a gain rounds down. A loss lies half way between two units: the double
# result is the even one of them.
UNIT = 1 << 53
X_INITIAL, X_LOCKED = int(INITIAL * UNIT), int(LOCKED * UNIT)
X_GAIN, X_LOSS = int(Fraction(GAIN) * UNIT), int(Fraction(LOSS) * UNIT)
SEGMENT_CALLS = 1 << 16
SEGMENTS_JOINED = 1 << 10
#: Segments of at most this many calls reach Python as rows of a batch, longer ones as a group each.
SHORT_SEGMENT = 1 << 8

REGISTRY_DDL = (
    "command string, source string, strategy string, calls bigint, confidence double, "
    "avg_raw_tokens double, avg_compressed_tokens double, compression_ratio double, hot boolean, "
    "user_override boolean, last_seen timestamp, params string"
)


def empty_registry(calls: DataFrame) -> DataFrame:
    """No entries yet; ``last_seen`` has the type of the calls' time."""
    ddl = REGISTRY_DDL.replace("last_seen timestamp", f"last_seen {calls.schema['ts'].dataType.simpleString()}")
    return calls.sparkSession.createDataFrame([], ddl)


def usable_entries(registry: DataFrame) -> DataFrame:
    """Entries a lookup may return: set by the user, confident, or seen often enough."""
    confident = F.col("confidence") >= F.lit(HOT)
    warm = (F.col("calls") >= WARM_CALLS) & (F.col("confidence") >= F.lit(WARM))
    return registry.filter(F.col("user_override") | confident | warm).withColumn(
        "hot", F.col("hot") & (F.col("user_override") | confident)
    )


def _state(shape: Column, confidence: Column) -> Column:
    return F.struct(shape.alias("shape"), confidence.cast("double").alias("confidence"))


def _learn(state: Column, shape: Column) -> Column:
    """State after one call."""
    up = F.least(F.lit(1.0), state["confidence"] + F.lit(GAIN))
    down = state["confidence"] - F.lit(LOSS)
    return (
        F.when(state["confidence"] >= F.lit(LOCKED), state)
        .when(state["shape"] == shape, _state(state["shape"], up))
        .when(down < F.lit(INITIAL), _state(shape, F.lit(INITIAL)))
        .otherwise(_state(state["shape"], down))
    )


PIECE_DDL = "start:string,odd:bigint,lo:bigint,hi:bigint,shape:string,offset:bigint,confidence:double"
PIECES_DDL = f"command string, seg bigint, pieces array<struct<{PIECE_DDL}>>"


def _segment_pieces(shapes: list[str]) -> list[dict]:
    """The function of one segment on unlocked start states, in pieces.

    A piece takes starts of one shape and parity with ``lo <= x < hi`` units, and either adds
    ``offset`` units or sets ``confidence``. Starts of one shape and parity move together until
    the top locks or the bottom is reset. A reset forgets the start, so all starts that
    a call resets go on as one.
    """
    pieces: list[dict] = []
    groups = {(start, odd): (X_INITIAL, X_LOCKED, 0) for start in {*shapes, ""} for odd in (0, 1)}
    reset: dict[tuple[str, float], list[dict]] = {}
    for call in shapes:
        after: dict[tuple[str, float], list[dict]] = {}
        for (shape, confidence), starts in reset.items():
            if shape == call:
                confidence = min(1.0, confidence + GAIN)
            elif confidence - LOSS < INITIAL:
                shape, confidence = call, INITIAL
            else:
                confidence -= LOSS
            if confidence >= LOCKED:
                pieces += [{**s, "shape": shape, "confidence": confidence} for s in starts]
            else:
                after.setdefault((shape, confidence), []).extend(starts)
        still = {}
        for (start, odd), (lo, hi, offset) in groups.items():
            if call == start:
                offset += X_GAIN
                edge = max(lo, min(hi, X_LOCKED - offset))
                if edge < hi:
                    pieces.append({"start": start, "odd": odd, "lo": edge, "hi": hi, "shape": start, "offset": offset})
                hi = edge
            else:
                edge = min(hi, max(lo, X_INITIAL + X_LOSS - offset + 1))
                if lo < edge:
                    after.setdefault((call, INITIAL), []).append({"start": start, "odd": odd, "lo": lo, "hi": edge})
                lo = edge
                offset -= X_LOSS + (odd + offset) % 2
            if lo < hi:
                still[start, odd] = lo, hi, offset
        groups, reset = still, after
        if not groups and not reset:
            break
    for (start, odd), (lo, hi, offset) in groups.items():
        pieces.append({"start": start, "odd": odd, "lo": lo, "hi": hi, "shape": start, "offset": offset})
    for (shape, confidence), starts in reset.items():
        pieces += [{**s, "shape": shape, "confidence": confidence} for s in starts]
    return pieces


def _fold_segment(calls: pd.DataFrame) -> pd.DataFrame:
    calls = calls.sort_values("pos")
    pieces = [{"offset": None, "confidence": None, **p} for p in _segment_pieces(calls["shape"].tolist())]
    return pd.DataFrame({"command": [calls["command"].iloc[0]], "seg": [calls["seg"].iloc[0]], "pieces": [pieces]})


def _fold_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for segments in batches:
        folded = [
            [{"offset": None, "confidence": None, **p} for p in _segment_pieces(list(shapes))] for shapes in segments["shapes"]
        ]
        yield pd.DataFrame({"command": segments["command"], "seg": segments["seg"], "pieces": pd.Series(folded, dtype=object)})


def _after(pieces: list[dict], start: str, odd: int) -> list[dict]:
    """Pieces for starts of one shape and parity."""
    known = any(p["start"] == start for p in pieces)
    return [p for p in pieces if p["start"] == (start if known else "") and p["odd"] == odd]


def _value(pieces: list[dict], shape: str, confidence: float) -> tuple[str, float]:
    """A function applied to one unlocked state."""
    x = int(confidence * UNIT)
    piece = next(p for p in _after(pieces, shape, x % 2) if p["lo"] <= x < p["hi"])
    if piece["confidence"] is None:
        return shape, min(UNIT, x + piece["offset"]) / UNIT
    return piece["shape"], piece["confidence"]


def _compose(first: list[dict], then: list[dict]) -> list[dict]:
    """The function of two neighbouring segments."""
    out = []
    for start in {p["start"] for p in first} | {p["start"] for p in then}:
        for piece in [p for odd in (0, 1) for p in _after(first, start, odd)]:
            piece = {**piece, "start": start, "shape": start if piece["confidence"] is None else piece["shape"]}
            if piece["confidence"] is not None:
                if piece["confidence"] < LOCKED:
                    shape, confidence = _value(then, piece["shape"], piece["confidence"])
                    piece = {**piece, "shape": shape, "confidence": confidence}
                out.append(piece)
            elif piece["lo"] + piece["offset"] >= X_LOCKED:
                out.append(piece)
            else:
                shift = piece["offset"]
                for more in _after(then, start, (piece["odd"] + shift) % 2):
                    lo, hi = max(piece["lo"], more["lo"] - shift), min(piece["hi"], more["hi"] - shift)
                    if lo < hi and more["confidence"] is None:
                        out.append({**piece, "lo": lo, "hi": hi, "offset": shift + more["offset"]})
                    elif lo < hi:
                        out.append({**more, "start": start, "odd": piece["odd"], "lo": lo, "hi": hi})
    return out


def _join_segments(segments: pd.DataFrame) -> pd.DataFrame:
    """The functions of neighbouring segments as one."""
    segments = segments.sort_values("seg")
    joined = reduce(_compose, [list(pieces) for pieces in segments["pieces"]])
    return pd.DataFrame(
        {"command": [segments["command"].iloc[0]], "seg": [segments["up"].iloc[0]], "pieces": [joined]}
    )


def _apply_pieces(state: Column, segment: Column) -> Column:
    x = (state["confidence"] * F.lit(float(UNIT))).cast("bigint")
    known = F.exists(segment["pieces"], lambda p: p["start"] == state["shape"])
    start = F.when(known, state["shape"]).otherwise(F.lit(""))
    hit = F.filter(
        segment["pieces"],
        lambda p: (p["start"] == start) & (p["odd"] == x % 2) & (p["lo"] <= x) & (x < p["hi"]),
    )[0]
    moved = F.least(F.lit(UNIT), x + hit["offset"]) / F.lit(float(UNIT))
    shape = F.when(hit["confidence"].isNull(), state["shape"]).otherwise(hit["shape"])
    locked = state["confidence"] >= F.lit(LOCKED)
    return F.when(locked, state).otherwise(_state(shape, F.coalesce(hit["confidence"], moved)))


def learn_fold(
    calls: DataFrame,
    registry: DataFrame | None = None,
    segment_calls: int = SEGMENT_CALLS,
    segments_joined: int = SEGMENTS_JOINED,
) -> DataFrame:
    """``(command, strategy, confidence)`` after folding the calls ``(command, seq, shape)``."""
    bucket = F.floor(F.col("seq") / F.lit(segment_calls))
    ranked = number_lines(calls.select("command", "seq", "shape"), "command", ["seq"], bucket)
    ranked = ranked.withColumn("seg", F.floor(F.col("pos") / F.lit(segment_calls)).cast("bigint"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "shape")))
    shapes = F.transform(ordered, lambda c: c["shape"]).alias("shapes")
    first = ranked.filter("seg = 0").groupBy("command").agg(shapes)
    if registry is None:
        first = first.withColumn("prior", F.lit(None).cast("struct<shape:string,confidence:double,frozen:boolean>"))
    else:
        prior = registry.select(
            "command",
            F.struct(
                F.col("strategy").alias("shape"),
                "confidence",
                ((F.col("source") == "user") | F.col("user_override")).alias("frozen"),
            ).alias("prior"),
        )
        first = first.join(prior, "command", "left")
    new = F.col("prior").isNull()
    start = F.when(new, _state(F.get("shapes", F.lit(0)), F.lit(INITIAL))).otherwise(
        _state(F.col("prior.shape"), F.col("prior.confidence"))
    )
    todo = F.when(new, F.slice("shapes", F.lit(2), F.size("shapes"))).otherwise(F.col("shapes"))
    first = first.withColumn("state", F.aggregate(todo, start, _learn))
    later = ranked.filter("seg > 0").groupBy("command", "seg")
    if segment_calls <= SHORT_SEGMENT:  # a row each, so that Python takes many at once
        later = later.agg(shapes).mapInPandas(_fold_segments, PIECES_DDL)
    else:
        later = later.applyInPandas(_fold_segment, PIECES_DDL)
    later = later.withColumn("up", F.floor(F.col("seg") / F.lit(segments_joined)).cast("bigint"))
    later = later.groupBy("command", "up").applyInPandas(_join_segments, PIECES_DDL)
    # one small row per segment_calls * segments_joined calls
    later = later.groupBy("command").agg(F.array_sort(F.collect_list(F.struct("seg", "pieces"))).alias("segments"))
    folded = first.join(later, "command", "left")
    segments = F.coalesce("segments", F.array().cast(later.schema["segments"].dataType))
    end = F.aggregate(segments, F.col("state"), _apply_pieces)
    frozen = F.coalesce(F.col("prior.frozen"), F.lit(False))
    final = F.when(frozen, _state(F.col("prior.shape"), F.col("prior.confidence"))).otherwise(end)
    return folded.select("command", final.alias("final")).select(
        "command",
        F.col("final.shape").alias("strategy"),
        F.col("final.confidence").alias("confidence"),
    )


def learn_averages(calls: DataFrame) -> DataFrame:
    """Calls and mean token counts per command (partial sums first, so hot commands are fine)."""
    return calls.groupBy("command").agg(
        F.count("*").alias("calls"),
        F.avg("raw").alias("avg_raw_tokens"),
        F.avg("comp").alias("avg_compressed_tokens"),
        F.max("ts").alias("last_seen"),
    )


def is_hot(calls: Column, confidence: Column) -> Column:
    return (calls >= HOT_CALLS) & (confidence >= F.lit(HOT))


def merge_registry(
    calls: DataFrame, registry: DataFrame | None = None, segment_calls: int = SEGMENT_CALLS
) -> DataFrame:
    """New registry snapshot: entries of the old one, updated and extended by a call log."""
    batch = learn_averages(calls).join(learn_fold(calls, registry, segment_calls), "command")
    batch = batch.select("command", F.struct(*[c for c in batch.columns if c != "command"]).alias("b"))
    if registry is None:
        registry = empty_registry(calls)
    old = registry.select("command", F.struct(*[c for c in registry.columns if c != "command"]).alias("o"))
    zero = F.lit(0).cast("bigint")
    before, added = F.coalesce("o.calls", zero), F.coalesce("b.calls", zero)
    count = before + added

    def mean(name: str) -> Column:
        total = F.coalesce(F.col(f"o.{name}") * before, F.lit(0.0)) + F.coalesce(
            F.col(f"b.{name}") * added, F.lit(0.0)
        )
        return F.when(added == 0, F.col(f"o.{name}")).otherwise(total / count)

    df = old.join(batch, "command", "full").select(
        "command",
        F.coalesce("o.source", F.lit("learned")).alias("source"),
        F.coalesce("b.strategy", "o.strategy").alias("strategy"),
        count.alias("calls"),
        F.coalesce("b.confidence", "o.confidence").alias("confidence"),
        mean("avg_raw_tokens").alias("avg_raw_tokens"),
        mean("avg_compressed_tokens").alias("avg_compressed_tokens"),
        F.coalesce("o.hot", F.lit(False)).alias("was_hot"),
        (added > 0).alias("touched"),
        F.coalesce("o.user_override", F.lit(False)).alias("user_override"),
        F.coalesce("b.last_seen", "o.last_seen").alias("last_seen"),
        F.coalesce("o.params", F.lit("{}")).alias("params"),
    )
    ratio = F.when(F.col("avg_raw_tokens") > 0, F.col("avg_compressed_tokens") / F.col("avg_raw_tokens"))
    hot = F.when(F.col("touched"), is_hot(F.col("calls"), F.col("confidence")))
    return df.select(
        "command",
        "source",
        "strategy",
        "calls",
        "confidence",
        "avg_raw_tokens",
        "avg_compressed_tokens",
        F.coalesce(ratio, F.lit(0.0)).alias("compression_ratio"),
        F.coalesce(hot, F.col("was_hot")).alias("hot"),
        "user_override",
        "last_seen",
        "params",
    )


def reset_commands(registry: DataFrame, commands: DataFrame) -> DataFrame:
    """Put the listed commands back to the first confidence; averages stay."""
    listed = commands.select("command").distinct().withColumn("_reset", F.lit(True))
    reset = F.coalesce("_reset", F.lit(False))
    df = registry.join(listed, "command", "left")
    return df.withColumns(
        {
            "confidence": F.when(reset, F.lit(INITIAL)).otherwise(F.col("confidence")),
            "hot": F.col("hot") & ~reset,
            "calls": F.when(reset, F.lit(0).cast("bigint")).otherwise(F.col("calls")),
        }
    ).select(*registry.columns)


def reset_all(registry: DataFrame) -> DataFrame:
    return registry.filter(F.lit(False))


def registry_entries(registry: DataFrame) -> DataFrame:
    return registry.selectExpr(*[part.split()[0] for part in REGISTRY_DDL.split(", ")])


def registry_summary(registry: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: commands learned, tokens saved, hot commands."""
    learned = registry.select(F.lit(1).alias("entry"), F.col("hot").cast("int").alias("hot"), F.lit(0).alias("saved"))
    saved = calls.select(F.lit(0), F.lit(0), F.greatest(F.lit(0), F.col("raw") - F.col("comp")))
    return learned.union(saved).agg(
        F.sum("entry").alias("total_learned"),
        F.sum("saved").alias("total_tokens_saved"),
        F.sum("hot").alias("n_hot"),
    )


def hot_commands(registry: DataFrame) -> DataFrame:
    return registry.filter("hot").select("command")


def session_count(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count_distinct("session_id").alias("session_count"))
