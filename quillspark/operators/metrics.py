"""Classification metrics as aggregates: everything beyond one pass works on k x k cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.storage import running_sum

ZERO_DIVISION = ("zero", "one", "nan", "throw")


class UndefinedMetricError(ValueError):
    """A metric divides by zero and the policy is 'throw'."""


def _weighted(df: DataFrame, y_true: str, y_pred: str, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.where(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull()).select(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"), w.alias("w"))


def accuracy(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", weight: str | None = None, normalize: bool = True) -> DataFrame:
    """accuracy: the weight of right rows, over that of all rows if normalize. Null rows drop out."""
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("w")).otherwise(0.0))
    return _weighted(df, y_true, y_pred, weight).agg((right / F.sum("w") if normalize else right).alias("accuracy"))


@dataclass(frozen=True)
class Confusion:
    """Cells (y_true, y_pred, weight) of all observed labels, and the label table
    (label, ord, requested): requested labels first, then other observed ones, ascending."""

    cells: DataFrame
    labels: DataFrame

    def matrix(self) -> DataFrame:
        """(y_true, y_pred, weight) over requested labels, zeros included."""
        asked = self.labels.where("requested").select("label")
        grid = asked.select(F.col("label").alias("y_true")).join(asked.select(F.col("label").alias("y_pred")), how="cross")
        return grid.join(self.cells, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("weight", F.lit(0.0)).alias("weight"))

    def total(self) -> DataFrame:
        return self.matrix().agg(F.sum("weight").alias("total"))

    def accuracy(self) -> DataFrame:
        """The diagonal over all requested cells; under a label subset not the same as accuracy()."""
        right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("weight")).otherwise(0.0))
        return self.matrix().agg((right / F.sum("weight")).alias("accuracy"))

    def per_class(self) -> DataFrame:
        """(label, ord, tp, pred, support) of each requested label, over all observed ones."""
        tp = self.cells.where("y_true = y_pred").select(F.col("y_true").alias("label"), F.col("weight").alias("tp"))
        pred = self.cells.groupBy(F.col("y_pred").alias("label")).agg(F.sum("weight").alias("pred"))
        support = self.cells.groupBy(F.col("y_true").alias("label")).agg(F.sum("weight").alias("support"))
        asked = self.labels.where("requested").select("label", "ord")
        joined = asked.join(tp, "label", "left").join(pred, "label", "left").join(support, "label", "left")
        return joined.na.fill(0.0, ["tp", "pred", "support"])


def confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", weight: str | None = None, labels: list | None = None) -> Confusion:
    """One pass over the rows. labels must differ; at least one must occur as a true label."""
    cells = _weighted(df, y_true, y_pred, weight).groupBy("y_true", "y_pred").agg(F.sum("w").alias("weight"))
    seen = cells.select(F.col("y_true").alias("label")).union(cells.select("y_pred")).distinct()
    if labels is None:
        numbered = seen.select("label", (F.row_number().over(W.orderBy("label")) - 1).alias("ord"), F.lit(True).alias("requested"))
        return Confusion(cells, numbered)
    if len(set(labels)) != len(labels):
        raise ValueError("labels occur twice")
    kind = dict(df.dtypes)[y_true]
    if not cells.where(F.col("y_true").isin(labels)).limit(1).count():
        raise ValueError("no requested label occurs in y_true")
    asked = df.sparkSession.createDataFrame([(x, i, True) for i, x in enumerate(labels)], f"label {kind}, ord int, requested boolean")
    rest = seen.join(asked, "label", "left_anti")
    rest = rest.select("label", (F.row_number().over(W.orderBy("label")) + len(labels) - 1).alias("ord"), F.lit(False).alias("requested"))
    return Confusion(cells, asked.union(rest))


def _ratio(top: Column, below: Column, zero_division: str, what: str) -> Column:
    if zero_division not in ZERO_DIVISION:
        raise ValueError(f"unknown policy {zero_division}")
    other = {"zero": F.lit(0.0), "one": F.lit(1.0), "nan": F.lit(float("nan")), "throw": F.raise_error(F.lit(f"{what} is undefined")).cast("double")}
    return F.when(below == 0, other[zero_division]).otherwise(top / F.nullif(below, F.lit(0.0)))


def _scores(tp: Column, pred: Column, support: Column, beta: float, zero_division: str) -> dict[str, Column]:
    if not 0 <= beta < float("inf"):
        raise ValueError("beta must be finite and not negative")
    b = beta * beta
    return {
        "precision": _ratio(tp, pred, zero_division, "precision"),
        "recall": _ratio(tp, support, zero_division, "recall"),
        "fbeta": _ratio((1 + b) * tp, pred + b * support, zero_division, "F-score"),
    }


def per_class(c: Confusion, beta: float = 1.0, zero_division: str = "zero") -> DataFrame:
    """(label, ord, precision, recall, fbeta, support)."""
    s = _scores(F.col("tp"), F.col("pred"), F.col("support"), beta, zero_division)
    return c.per_class().select("label", "ord", *[v.alias(k) for k, v in s.items()], "support")


def average(c: Confusion, averaging: str, beta: float = 1.0, zero_division: str = "zero", pos_label=1) -> DataFrame:
    """One row (precision, recall, fbeta, support): binary, micro, macro or weighted."""
    names = ("precision", "recall", "fbeta")
    if averaging == "micro":
        sums = c.per_class().agg(*[F.sum(x).alias(x) for x in ("tp", "pred", "support")])
        s = _scores(F.col("tp"), F.col("pred"), F.col("support"), beta, zero_division)
        return sums.select(*[v.alias(k) for k, v in s.items()], "support")
    rows = per_class(c, beta, zero_division)
    if averaging == "binary":
        known = c.labels.agg(F.count("*").alias("n"), F.max(F.col("label") == pos_label).alias("there"), F.min("requested").alias("all")).first()
        if known.n > 2 or not known.there or not known["all"]:
            raise ValueError("binary averaging needs at most two labels, all of them requested, pos_label among them")
        return rows.where(F.col("label") == pos_label).select(*names, "support")
    if averaging == "macro":
        return rows.agg(*[F.avg(x).alias(x) for x in names], F.sum("support").alias("support"))
    if averaging == "weighted":
        total = F.sum("support")
        mean = lambda x: F.when(total == 0, 0.0).otherwise(F.sum(F.when(F.col("support") == 0, 0.0).otherwise(F.col(x) * F.col("support"))) / F.nullif(total, F.lit(0.0)))
        return rows.agg(*[mean(x).alias(x) for x in names], total.alias("support"))
    raise ValueError(f"unknown averaging {averaging}")


def report(c: Confusion, zero_division: str = "zero") -> DataFrame:
    """(section, name, precision, recall, f1, support): a row per requested label, accuracy (micro
    avg instead if an observed label was left out), macro avg and weighted avg."""
    cols = ["section", "name", "precision", "recall", "f1", "support"]
    rows = per_class(c, 1.0, zero_division)
    out = rows.select(F.lit(0).alias("section"), F.col("label").cast("string").alias("name"), "precision", "recall", F.col("fbeta").alias("f1"), "support")
    partial = c.labels.where("not requested").limit(1).count() > 0
    if partial:
        micro = average(c, "micro", 1.0, zero_division)
        out = out.union(micro.select(F.lit(1), F.lit("micro avg"), "precision", "recall", "fbeta", "support"))
    else:
        every = rows.agg(F.sum("support").alias("support")).join(c.accuracy(), how="cross")
        none = F.lit(None).cast("double")
        out = out.union(every.select(F.lit(1), F.lit("accuracy"), none, none, F.col("accuracy"), "support"))
    for i, kind in enumerate(("macro", "weighted"), 2):
        out = out.union(average(c, kind, 1.0, zero_division).select(F.lit(i), F.lit(f"{kind} avg"), "precision", "recall", "fbeta", "support"))
    return out.toDF(*cols)


def report_text(rep: DataFrame, digits: int = 2, names: list[str] | None = None, weighted: bool = False) -> str:
    """The report as fixed-width text. Reads the report's few rows. Supports print as whole numbers
    unless weighted, or if no row at all was right."""
    rows = rep.orderBy("section").collect()
    classes = sorted((r for r in rows if r.section == 0), key=lambda r: (not r.name.lstrip("-").isdigit(), int(r.name) if r.name.lstrip("-").isdigit() else 0, r.name))
    shown = [(names[i] if names else r.name, r) for i, r in enumerate(classes)]
    rest = [(r.name, r) for r in rows if r.section]
    floats = weighted or not any((r.f1 or 0) > 0 for r in rows)
    width = max([12, digits, *(len(n) for n, _ in shown + rest)])
    supp = (lambda s: str(float(s))) if floats else (lambda s: str(int(s)))
    head = " " * width + " " + "".join(f" {h:>9}" for h in ("precision", "recall", "f1-score", "support"))
    lines = [head, ""]
    num = lambda v: f" {v:>9.{digits}f}"
    for name, r in shown:
        lines.append(f"{name:>{width}} " + num(r.precision) + num(r.recall) + num(r.f1) + f" {supp(r.support):>9}")
    lines.append("")
    for name, r in rest:
        middle = f" {'':>9} {'':>9}" if name == "accuracy" else num(r.precision) + num(r.recall)
        lines.append(f"{name:>{width}} " + middle + num(r.f1) + f" {supp(r.support):>9}")
    return "\n".join(lines) + "\n"


# ---------------------------------------------------------------- ROC


def _auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auc, pos, neg) from rows (keys, positive, score, w): equal scores are one step of
    the curve, areas are trapezoids. Rows are first summed by score, and ranges of scores are
    summed apart."""
    groups = rows.groupBy(*keys, "score").agg(F.sum(F.when(F.col("positive"), F.col("w")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("positive"), 0.0).otherwise(F.col("w"))).alias("f"))
    steps = running_sum(groups, keys, F.desc("score"), "p", "tp")
    area = F.sum(F.col("f") * (2 * F.col("tp") - F.col("p")) / 2)
    return steps.groupBy(*keys).agg(area.alias("area"), F.sum("p").alias("pos"), F.sum("f").alias("neg")).select(*keys, (F.col("area") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0.0))).alias("auc"), "pos", "neg")


def roc_auc(df: DataFrame, y_true: str = "y_true", score: str = "score", weight: str | None = None, pos_label=1) -> DataFrame:
    """One row (auc). Fails on a NaN score, and if only one class occurs or no row at all."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    s = F.col(score).cast("double")
    s = F.when(F.isnan(s), F.raise_error(F.lit("a score is NaN")).cast("double")).otherwise(s)
    rows = df.where(F.col(y_true).isNotNull() & F.col(score).isNotNull()).select((F.col(y_true) == pos_label).alias("positive"), s.alias("score"), w.alias("w"))
    got = _auc(rows, [])
    return got.agg(F.max("auc").alias("auc")).select(F.when(F.col("auc").isNull(), F.raise_error(F.lit("both classes are needed")).cast("double")).otherwise(F.col("auc")).alias("auc"))


def roc_auc_multiclass(df: DataFrame, y_true: str, scores: str, labels: list, strategy: str = "ovr", averaging: str = "macro", weight: str | None = None) -> DataFrame:
    """One row (auc). scores: array<double>, a probability per label of `labels` (ascending).

    ovr: the mean of the classes' one-against-rest areas; ovo: of the pairs' (Hand and Till), each
    the mean of both orders. macro weighs alike, weighted by prevalence; ovo takes no weights.
    """
    if averaging not in ("macro", "weighted") or strategy not in ("ovr", "ovo"):
        raise ValueError("averaging is macro or weighted, strategy ovr or ovo")
    if labels != sorted(set(labels)) or len(labels) < 2:
        raise ValueError("labels must be ascending and differ")
    if strategy == "ovo" and weight:
        raise ValueError("one against one takes no weights")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x.cast("double"))
    ok = (F.size(scores) == len(labels)) & (F.abs(total - 1) <= 1e-8 + 1e-5)
    checked = F.when(ok, F.col(scores)).otherwise(F.raise_error(F.lit("scores of a row must be one per label and sum to 1")).cast("array<double>"))
    rows = df.where(F.col(y_true).isNotNull()).select(F.col(y_true).alias("y"), checked.alias("s"), w.alias("w"))
    names = F.array(*map(F.lit, labels))
    if strategy == "ovr":
        each = rows.select("y", "w", F.posexplode("s").alias("i", "score")).withColumn("class", F.element_at(names, F.col("i") + 1))
        aucs = _auc(each.select("class", (F.col("y") == F.col("class")).alias("positive"), "score", "w"), ["class"])
        mean = F.avg("auc") if averaging == "macro" else F.sum(F.col("auc") * F.col("pos")) / F.sum("pos")
        return aucs.agg(mean.alias("auc"))
    # a row of class y is positive against every other class b by score y, and negative by score b
    place = F.array_position(names, F.col("y")).cast("int")
    each = rows.withColumn("yi", place).select("y", "yi", "s", "w", F.posexplode(names).alias("i", "b")).where("y <> b")
    pos = each.select(F.col("y").alias("a"), "b", F.lit(True).alias("positive"), F.element_at("s", F.col("yi")).alias("score"), "w")
    neg = each.select(F.col("b").alias("a"), F.col("y").alias("b"), F.lit(False).alias("positive"), F.element_at("s", F.col("i") + 1).alias("score"), "w")
    ordered = _auc(pos.union(neg), ["a", "b"])
    pairs = ordered.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.avg("auc").alias("auc"), F.first(F.col("pos") + F.col("neg")).alias("n"))
    mean = F.avg("auc") if averaging == "macro" else F.sum(F.col("auc") * F.col("n")) / F.sum("n")
    return pairs.agg(mean.alias("auc"))
