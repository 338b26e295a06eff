"""Problem 1: one measured quantity recorded in many units and scales, brought to common units.

Stated units are read from the text, a unit key or a noted heading. Where a statement has none, a random forest trained on the
stated ones predicts the unit from magnitude, source, category and neighbouring figures; its confidence is calibrated by an
isotonic fit on held-out rows. Confident predictions are converted, the rest is marked for review.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import COMMON, SIZE, UNITS, number, quantity, unit_in_header, unit_of

UNIT_NAMES = [u for u, _, _, _ in UNITS]
KINDS = list(COMMON)
#: Key of a second statement in the papers, and the kind of quantity it holds.
SECOND = {"meters": "length", "area": "area", "net_weight": "weight", "volume": "volume", "pcs": "count"}
_COLUMNS = ["record_kind", "record_id", "value", "unit", "others"]
FEATURES = ["f_value", "f_scale", "f_net", "f_gross", "f_packs", "f_chapter", "f_heading", "f_source", "f_currency", "f_record"]
UNKNOWN = -99.0
_COLUMNS += FEATURES
_NO_FEATURES = (UNKNOWN,) * len(FEATURES)


_OTHERS = "array<struct<kind: string, value: double, unit: string, stated: boolean>>"
_SCHEMA = "record_kind string, record_id bigint, value double, unit string, others " + _OTHERS + ", " + ", ".join(f"{f} double" for f in FEATURES)


def _log(x) -> float:
    return math.log10(x) if x is not None and x > 0 and math.isfinite(x) else UNKNOWN


def _ratio(a, b) -> float:
    return _log(a / b) if a is not None and b else UNKNOWN


def _digits(code, n: int) -> float:
    d = re.sub(r"\D", "", code)[:n] if isinstance(code, str) else ""
    return float(d) if len(d) == n else UNKNOWN


def _bucket(text, n: int) -> float:
    return float(zlib.crc32(text.encode()) % n) if text else UNKNOWN


def _features(value, price, amount, net, gross, packs, code, source, currency, record) -> tuple[float, ...]:
    money = value * price if value is not None and price is not None else None
    return (_log(value), _ratio(money, amount), _ratio(net, value), _ratio(gross, value), _ratio(value, packs), _digits(code, 2), _digits(code, 4), _bucket(source, 32), _bucket(currency, 16), float(record))


def _number(x) -> float | None:
    """A plain figure of a column or of JSON; None for nulls, NaN and texts that aren't just a number."""
    if isinstance(x, str):
        x = number(x)
    return None if x is None or isinstance(x, bool) or not isinstance(x, int | float) or x != x else float(x)


def _stated(x) -> tuple[float | None, str | None]:
    return quantity(x) if isinstance(x, str) else (_number(x), None)


def line_statements(lines: DataFrame, every_feature: bool = True) -> DataFrame:
    """Each line's statements: the main one from qty_text, the other from the entry of extra that isn't a note, else from pieces.

    Arrow batches in, one narrow row out for each line with an id; nothing is shuffled. Without `every_feature` the
    model's features are made only for statements that lack a unit.
    """
    columns = ["line_id", "qty_text", "extra", "pieces", "price", "amount", "net", "gross", "packages", "hs", "source"]

    def run(frames):
        for pdf in frames:
            out = []
            for line, text, extra, *rest in zip(*(pdf[c] for c in columns)):
                pieces, price, amount, net, gross, packs = map(_number, rest[:6])
                value, unit = quantity(text)
                key, entry = next(((k, v) for k, v in (dict(extra).items() if extra else ()) if k in SECOND), (None, None))
                if key:
                    other = (SECOND[key], *_stated(entry))
                else:
                    other = ("count", pieces, None)
                others = [(other[0], other[1], other[2] or COMMON[other[0]], other[2] is not None)] if other[1] is not None else []
                plain = every_feature or unit is None
                out.append(("line", line, value, unit, others, *(_features(value, price, amount, net, gross, packs, rest[6], re.match(r"[^\W\d]*", rest[7] or "")[0], None, 0) if plain else _NO_FEATURES)))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return lines.where("line_id is not null").select(*columns).mapInPandas(run, _SCHEMA)


def _json(text) -> dict:
    try:
        got = json.loads(text) if text else {}
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def item_statements(items: DataFrame, every_feature: bool = True) -> DataFrame:
    """Each item's statements: the main one is qty of commercial_data, the others what packing_data has for each kind.

    A unit in the text counts before the unit key, that before the one in the noted heading. Broken or empty JSON has no
    statements.
    """
    columns = ["recon_id", "commercial_data", "packing_data", "customs_data"]

    def run(frames):
        for pdf in frames:
            out = []
            for item, *texts in zip(*(pdf[c] for c in columns)):
                com, pack = _json(texts[0]), _json(texts[1])
                value, unit = _stated(com.get("qty"))
                unit = unit or unit_of(com.get("unit")) or unit_in_header(com.get("qty_header"))
                others = []
                for key, kind in SECOND.items():
                    v, u = _stated(pack.get(key))
                    if v is not None:
                        u = u or unit_of(pack.get(f"{key}_unit"))
                        others.append((kind, v, u or COMMON[kind], u is not None))
                if not every_feature and unit is not None:
                    out.append(("item", item, value, unit, others, *_NO_FEATURES))
                    continue
                customs = _json(texts[2])
                net = next((v * SIZE[u] for k, v, u, _ in others if k == "weight"), None)
                out.append(("item", item, value, unit, others, *_features(value, _number(com.get("price")), _number(com.get("amount")), net, _number(pack.get("gross_weight")), _number(pack.get("rolls")), customs.get("hs_code"), None, com.get("currency"), 1)))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return items.where("recon_id is not null").select(*columns).mapInPandas(run, _SCHEMA)


def _lookup(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def kind_of(unit: Column) -> Column:
    return F.element_at(_lookup({u: k for u, k, _, _ in UNITS}), unit)


def size_of(unit: Column) -> Column:
    """The unit's size in its kind's common unit: metre, square metre, kilogram, cubic metre or piece."""
    return F.element_at(_lookup(SIZE), unit)


@dataclass
class UnitModel:
    """A forest over UNIT_NAMES and the calibration of its top probability (None: too few labelled rows to train)."""

    forest: RandomForestClassificationModel | None
    raw: list[float]
    sure: list[float]

    def predict(self, rows: DataFrame) -> DataFrame:
        """`rows` with p_unit, p_kind and the calibrated p_sure of the predicted unit."""
        if self.forest is None:
            return rows.withColumns({"p_unit": F.lit(None).cast("string"), "p_kind": F.lit(None).cast("string"), "p_sure": F.lit(0.0)})
        out = self.forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
        p = vector_to_array("probability")
        out = out.withColumn("p_all", p).withColumn("p_top", F.array_max("p_all"))
        names = F.array(*(F.lit(u) for u in UNIT_NAMES))
        kinds = [F.aggregate(F.array(*(F.coalesce(F.get("p_all", F.lit(i)), F.lit(0.0)) for i, (_, k, _, _) in enumerate(UNITS) if k == kind)), F.lit(0.0), lambda a, x: a + x) for kind in KINDS]
        best = F.array_max(F.array(*(F.struct(s.alias("s"), F.lit(k).alias("k")) for s, k in zip(kinds, KINDS))))
        sure = F.lit(self.sure[-1])
        for x, y in list(zip(self.raw, self.sure))[-2::-1]:
            sure = F.when(F.col("p_top") <= x, y).otherwise(sure)
        out = out.withColumns({"p_unit": names[F.array_position("p_all", F.col("p_top")).cast("int") - 1], "p_kind": best["k"], "p_sure": sure})
        return out.drop("features", "rawPrediction", "probability", "prediction", "p_all", "p_top")


def _isotonic(raw: np.ndarray, right: np.ndarray, steps: int = 12) -> tuple[list[float], list[float]]:
    """Rising step function from raw confidence to the share that is right: neighbouring groups merge while they fall."""
    order = np.argsort(raw, kind="stable")
    groups = [[float(r[-1]), float(y.sum()), len(y)] for r, y in zip(np.array_split(raw[order], steps), np.array_split(right[order], steps)) if len(r)]
    merged: list[list[float]] = []
    for g in groups:
        merged.append(g)
        while len(merged) > 1 and merged[-2][1] / merged[-2][2] >= merged[-1][1] / merged[-1][2]:
            b = merged.pop()
            a = merged.pop()
            merged.append([b[0], a[1] + b[1], a[2] + b[2]])
    return [m[0] for m in merged], [(m[1] + 0.5) / (m[2] + 1) for m in merged]


def in_sample(*key: Column | str, share: float) -> Column:
    """Whether a record is among the `share` of all records, by the hash of its key, that the model is fitted on."""
    return F.pmod(F.xxhash64(F.lit(71), *key), F.lit(1 << 20)) < int(share * (1 << 20))


def sample_share(rows: int, sample: int = 20000) -> float:
    """The share that gives about `sample` of `rows` records, half of them at most, so that some are left to measure on."""
    return min(0.5, sample / max(rows, 1))


def train(statements: DataFrame, trees: int = 20, depth: int = 12, seed: int = 5) -> UnitModel:
    """The model from statements with a stated unit, a fifth of them held out of the forest for its calibration.

    All of `statements` come to the driver, so pass the records of a bounded sample (`in_sample`, filtered before they
    are parsed). Too few or all of one unit give a model that predicts nothing.
    """
    labels = F.create_map(*(F.lit(x) for kv in ((u, float(i)) for i, u in enumerate(UNIT_NAMES)) for x in kv))
    known = statements.where("unit is not null and value is not null").select(*FEATURES, F.element_at(labels, F.col("unit")).alias("label"), F.xxhash64("record_kind", "record_id").alias("h"))
    rows = known.toPandas().sort_values(["h", *FEATURES], ignore_index=True)
    if len(rows) < 50 or rows.label.nunique() < 2:
        return UnitModel(None, [], [])
    spark = statements.sparkSession
    held = np.arange(len(rows)) % 5 == 0
    fit = spark.createDataFrame(rows[~held].drop(columns="h")).coalesce(4)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, minInstancesPerNode=2).fit(assemble.transform(fit))
    test = forest.transform(assemble.transform(spark.createDataFrame(rows[held].drop(columns="h")).coalesce(4))).select("label", "prediction", F.array_max(vector_to_array("probability")).alias("p")).toPandas()
    return UnitModel(forest, *_isotonic(test.p.to_numpy(), (test.label == test.prediction).to_numpy(float)))


def masked(statements: DataFrame, model: UnitModel, least: float = 0.9) -> DataFrame:
    """Statements with their stated unit hidden and predicted: (record_kind, record_id, value, stated_unit, unit, common_value, sure, review).

    Pass statements that the model wasn't fitted or calibrated on. common_value is null for those less sure than `least`,
    which are for review.
    """
    hidden = statements.where("unit is not null and value is not null").withColumn("stated_unit", F.col("unit"))
    out = model.predict(hidden)
    sure = F.coalesce(F.col("p_sure") >= least, F.lit(False))
    return out.select("record_kind", "record_id", "value", "stated_unit", F.col("p_unit").alias("unit"), F.when(sure, F.col("value") * size_of(F.col("p_unit"))).alias("common_value"), F.col("p_sure").alias("sure"), (~sure).alias("review")).distinct()


def resolve(statements: DataFrame, model: UnitModel, least: float = 0.9) -> DataFrame:
    """Every main statement in its common unit: (record_kind, record_id, value, unit, how, common_value, common_unit, sure, review, others).

    how: stated, or predicted where no unit is stated; a prediction less sure than `least` is for review and not converted
    (null common_value). Null values and texts without a number are left out; repeated records come as often.
    """
    there = statements.where("value is not null")
    stated = there.where("unit is not null").select("record_kind", "record_id", "value", "unit", F.lit("stated").alias("how"), kind_of(F.col("unit")).alias("kind"), F.lit(1.0).alias("sure"), "others")
    guessed = model.predict(there.where("unit is null")).select("record_kind", "record_id", "value", F.col("p_unit").alias("unit"), F.lit("predicted").alias("how"), F.col("p_kind").alias("kind"), F.col("p_sure").alias("sure"), "others")
    both = stated.unionByName(guessed)
    commons = F.create_map(*(F.lit(x) for kv in COMMON.items() for x in kv))
    sure = F.col("sure") >= least
    return both.select("record_kind", "record_id", "value", "unit", "how", "kind", F.when(sure, F.col("value") * size_of(F.col("unit"))).alias("common_value"), F.element_at(commons, F.when(F.col("how") == "predicted", kind_of(F.col("unit"))).otherwise(F.col("kind"))).alias("common_unit"), "sure", (~sure).alias("review"), "others")


def every_quantity(statements: DataFrame, model: UnitModel, least: float = 0.9) -> DataFrame:
    """Each statement of each record in common units: (record_kind, record_id, slot, value, unit, how, common_value, common_unit, sure, review).

    slot is main or the kind of the second statement. how is stated, predicted (nothing states or implies a unit) or
    implied (the column or key says the common unit); an implied unit is kept, but marked for review where the model is
    sure of another unit of that kind.
    """
    main = resolve(statements, model, least).withColumn("slot", F.lit("main"))
    columns = ["record_kind", "record_id", "slot", "value", "unit", "how", "common_value", "common_unit", "sure", "review"]
    second = statements.select("*", F.explode("others").alias("o"))
    value = F.when(F.col("o.value") > 0, F.log10("o.value")).otherwise(UNKNOWN)
    moved = (F.col("f_value") != UNKNOWN) & (F.col("o.value") > 0)
    shift = lambda c, sign: F.when((F.col(c) != UNKNOWN) & moved, F.col(c) + sign * (value - F.col("f_value"))).otherwise(UNKNOWN).alias(c)
    second = second.select("record_kind", "record_id", F.col("o.kind").alias("slot"), F.col("o.value").alias("value"), F.col("o.unit").alias("unit"), F.col("o.stated").alias("stated"), value.alias("f_value"), shift("f_scale", 1), shift("f_net", -1), shift("f_gross", -1), shift("f_packs", 1), *FEATURES[5:])
    said = second.where("stated").select("*", F.lit("stated").alias("how"), F.lit(1.0).alias("sure"), F.lit(False).alias("review"))
    doubt = (F.col("p_sure") >= least) & (F.col("p_kind") == F.col("slot")) & (F.col("p_unit") != F.col("unit"))
    implied = model.predict(second.where("not stated")).select("*", F.lit("implied").alias("how"), F.when(doubt, 1 - F.col("p_sure")).otherwise(F.lit(1.0)).alias("sure"), F.coalesce(doubt, F.lit(False)).alias("review"))
    seconds = said.unionByName(implied, allowMissingColumns=True).select("*", (F.col("value") * size_of(F.col("unit"))).alias("common_value"), F.element_at(_lookup(COMMON), F.col("slot")).alias("common_unit"))
    return main.select(columns).unionByName(seconds.select(columns)).distinct()


def stated_twice(resolved: DataFrame, within: float = 0.01) -> DataFrame:
    """Distinct (record_kind, record_id) of records whose two statements have different units and agree within 1 %.

    A main statement without any unit counts as being in the common unit of its kind, as the two statements are compared
    as they stand; its kind is the predicted one if a second statement of that kind is there, else that of any there.
    """
    kind, plain = F.col("kind"), F.col("how") == "predicted"
    # a main statement's own kind; for one without a unit the predicted kind, or any if no second statement has that
    free = plain & ~F.exists("others", lambda x: (x["kind"] == kind) & x["value"].isNotNull())
    long = resolved.withColumn("free", free).select("record_kind", "record_id", "value", "unit", "kind", plain.alias("plain"), "free", F.explode("others").alias("o"))
    long = long.where("o.value is not null and (free or o.kind = kind)").select("record_kind", "record_id", "value", F.when(F.col("plain"), F.element_at(_lookup(COMMON), F.col("o.kind"))).otherwise(F.col("unit")).alias("unit"), F.col("o.value").alias("value_2"), F.col("o.unit").alias("unit_2"))
    long = long.where("unit != unit_2").select("record_kind", "record_id", (F.col("value") * size_of(F.col("unit"))).alias("a"), (F.col("value_2") * size_of(F.col("unit_2"))).alias("b"))
    return long.where(F.abs(F.col("a") - F.col("b")) <= (within + 1e-9) * F.greatest(F.abs("a"), F.abs("b"))).select("record_kind", "record_id").distinct()
