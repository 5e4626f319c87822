"""Training and evaluation of the supervised detectors."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.features import flow_features
from vigil.functions.lexical import query_features
from vigil.plans.ordered import numbered_rows, value_at_rank

FLOW_FEATURES = "duration_s total_packets total_bytes fwd_packets bwd_packets fwd_bytes bwd_bytes bytes_per_s packets_per_s fwd_pkt_len_mean bwd_pkt_len_mean down_up_ratio fwd_bwd_pkt_ratio syn_flag rst_flag is_tcp is_udp".split()
DNS_FEATURES = "label_length label_entropy digit_ratio rare_bigram_ratio dga_score subdomain_max_label_len subdomain_entropy num_labels qtype is_txt_or_null".split()


@dataclass
class Model:
    pipeline: PipelineModel
    features: list[str]
    labels: list[str]
    version: str = "1.0"
    importances: dict[str, float] = field(default_factory=dict)
    benign_means: dict[str, float] = field(default_factory=dict)

    def top_importances(self, n: int = 5) -> list[tuple[str, float]]:
        """The features that the model's skill depends on most, by falling importance."""
        return sorted(self.importances.items(), key=lambda x: -x[1])[:n]


def flow_rows(raw: DataFrame) -> DataFrame:
    """Labelled counters (duration, packets, bytes, proto, syn, rst) as features."""
    cols = [F.col(c) for c in ("duration", "pkts_fwd", "pkts_bwd", "bytes_fwd", "bytes_bwd", "proto", "syn", "rst")]
    return raw.select(*[c.alias(n) for n, c in flow_features(*cols).items()], "label", "seq")


def dns_rows(raw: DataFrame) -> DataFrame:
    return raw.select(*[c.alias(n) for n, c in query_features(F.col("query"), F.col("qtype")).items()], "label", "seq")


def fit(rows: DataFrame, features: list[str], trees: int = 40, depth: int = 10, seed: int = 7, version: str = "1.0") -> Model:
    index = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc").fit(rows)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label_index", numTrees=trees, maxDepth=depth, seed=seed)
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    fitted = Pipeline(stages=[assembler, forest]).fit(index.transform(rows))
    names = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=index.labels)
    return Model(PipelineModel([*fitted.stages, names]), features, list(index.labels), version)


def split(rows: DataFrame, test: float = 0.3, how: str = "stratified", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(train, test): each label's share by a hash of its rows, or the latest rows by seq."""
    if how == "temporal":
        last = value_at_rank(rows, "seq", int(rows.count() * (1 - test)))
        early = F.col("seq") <= last if last is not None else F.lit(False)
        return rows.filter(early), rows.filter(~early)
    u = F.pmod(F.xxhash64(F.lit(seed), "label", "seq"), F.lit(10_000)) < int(test * 10_000)
    return rows.filter(~u), rows.filter(u)


def capped(rows: DataFrame, most: dict[str, int], seed: int = 7) -> DataFrame:
    """At most so many rows of each label, drawn by hash."""
    nth = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), "seq"), "seq"))
    limit = F.create_map(*[F.lit(x) for p in most.items() for x in p])
    return rows.withColumn("_n", nth).filter(F.col("_n") <= F.coalesce(F.try_element_at(limit, F.col("label")), F.lit(2**31 - 1))).drop("_n")


def augmented(real: DataFrame, synthetic: DataFrame, floor: int, seed: int = 7) -> DataFrame:
    """real with synthetic rows for the labels that have fewer than ``floor``."""
    counts = {r["label"]: r["count"] for r in real.groupBy("label").count().collect()}
    wanted = {r[0]: max(0, floor - counts.get(r[0], 0)) for r in synthetic.select("label").distinct().collect()}
    return real.unionByName(capped(synthetic, wanted, seed))


def hybrid(real: DataFrame, synthetic: DataFrame, benign: int = 60_000, attack: int = 10_000, seed: int = 7) -> DataFrame:
    """Benign rows that are real, attacks that are synthetic."""
    most = {r[0]: attack for r in synthetic.select("label").distinct().collect()}
    return capped(real.filter("label = 'benign'"), {"benign": benign}, seed).unionByName(capped(synthetic.filter("label <> 'benign'"), most, seed))


def report(scored: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of each label, from (label, predicted_label)."""
    cells = scored.groupBy("label", "predicted_label").agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("label") == F.col("predicted_label"), F.col("n")).otherwise(0))
    actual = cells.groupBy("label").agg(hit.alias("tp"), F.sum("n").alias("support"))
    given = cells.groupBy(F.col("predicted_label").alias("label")).agg(F.sum("n").alias("given"))
    out = actual.join(given, "label", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    p, r = F.when(F.col("given") > 0, F.col("tp") / F.col("given")).otherwise(0.0), F.col("tp") / F.col("support")
    return out.select("label", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "support")


def macro_f1(scored: DataFrame) -> float:
    return report(scored).agg(F.avg("f1")).first()[0]


def importances(model: Model, rows: DataFrame, repeats: int = 5, seed: int = 7) -> dict[str, float]:
    """Loss of macro-F1 when one feature's values are dealt out anew; clipped at 0 and normalised."""
    rows = numbered_rows(rows.select(*model.features, "label", "seq"), ["seq", "label"], "_slot").cache()
    base, loss = macro_f1(model.pipeline.transform(rows)), {}
    for f in model.features:
        drops = []
        for i in range(repeats):
            other = rows.select(F.xxhash64(F.lit(seed + i), F.lit(f), "seq", "label").alias("_by"), F.col(f).alias("_new"), "seq", "label")
            other = numbered_rows(other, ["_by", "seq", "label"], "_slot").select("_slot", "_new")
            moved = rows.join(other, "_slot").withColumn(f, F.col("_new")).drop("_new")
            drops.append(base - macro_f1(model.pipeline.transform(moved)))
        loss[f] = max(0.0, sum(drops) / repeats)
    rows.unpersist()
    total = sum(loss.values()) or 1.0
    return {f: v / total for f, v in sorted(loss.items(), key=lambda x: -x[1])}


def benign_means(rows: DataFrame, features: list[str], benign: str = "benign") -> dict[str, float]:
    """Mean of each feature over the benign rows, to four places; empty if there are none."""
    own = rows.filter(F.col("label") == benign).agg(F.count("*").alias("n"), *[F.round(F.avg(f), 4).alias(f) for f in features]).first()
    return {f: own[f] for f in features} if own["n"] else {}


def _digest(folder: Path) -> str:
    h = hashlib.sha256()
    for p in sorted(x for x in folder.rglob("*") if x.is_file() and not x.name.startswith(".") and x.name != "card.json"):
        h.update(str(p.relative_to(folder)).encode() + b"\0" + p.read_bytes())
    return h.hexdigest()


def save(model: Model, folder: str, extra: dict | None = None) -> Path:
    """The model and a card with the hash of its files."""
    at = Path(folder)
    model.pipeline.write().overwrite().save(str(at / "model"))
    card = {"version": model.version, "features": model.features, "labels": model.labels, "importances": model.importances, "benign_means": model.benign_means, "sha256": _digest(at / "model")} | (extra or {})
    (at / "card.json").write_text(json.dumps(card, indent=2, sort_keys=True))
    return at / "card.json"


def load(folder: str) -> Model | None:
    """A saved model; None if there is none, refused if its files don't match the card."""
    at = Path(folder)
    if not (at / "card.json").exists():
        return None
    card = json.loads((at / "card.json").read_text())
    if _digest(at / "model") != card["sha256"]:
        raise ValueError("the model does not match its card")
    return Model(PipelineModel.load(str(at / "model")), card["features"], card["labels"], card["version"], card.get("importances", {}), card.get("benign_means", {}))
