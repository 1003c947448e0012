"""Entity resolution over one text column: keys, blocks, pairs, scores, clusters."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.functions.coerce import bare
from mergeloom.functions.keys import KeyTables, comparison_key
from mergeloom.operators.components import components
from mergeloom.operators.numbering import number_rows
from mergeloom.plans.contracts import Cluster, ClusterCandidate, ClusterMember, Clusters
from mergeloom.runtime import written

UNBLOCKED = "<unblocked>"
STRATEGIES = ("prefix", "brand", "category")


@dataclass(frozen=True)
class Thresholds:
    high: float = 0.85
    low: float = 0.60
    advice_floor: float = 0.5

    def __post_init__(self) -> None:
        if not all(0 <= x <= 1 for x in (self.high, self.low, self.advice_floor)) or self.low > self.high:
            raise ValueError("thresholds must be from 0 to 1, low not above high")


def value_frequency(df: DataFrame, column: str, ordinals: Sequence[str] = ()) -> DataFrame:
    """(idx, value, row_count): distinct non-blank values; idx is their first-seen order, if ordinals are given."""
    value = F.col(f"`{column}`")
    first = F.min(F.struct(*ordinals)) if ordinals else F.min(value)
    seen = df.where(value.isNotNull() & (bare(value) != "")).groupBy(value.alias("value")).agg(F.count("*").alias("row_count"), first.alias("_first"))
    ranked = number_rows(seen, ("_first", "value"), "idx")
    return ranked.select("idx", "value", "row_count")


def with_blocks(records: DataFrame, strategy: Sequence[str] = ("prefix",), prefix_length: int = 3, value: str = "value",
                brand: str | None = None, category: str | None = None, tables: KeyTables | None = None) -> DataFrame:
    """records with key and block; a record that lacks any part of its block key is unblocked."""
    if not strategy or set(strategy) - set(STRATEGIES):
        raise ValueError(f"strategy must name some of {', '.join(STRATEGIES)}")
    if prefix_length < 1:
        raise ValueError("prefix_length must be at least 1")
    for name in (value, *[c for c in (brand, category) if c]):
        if name not in records.columns:
            raise ValueError(f"there is no column {name}")
    if "category" in strategy and not category:
        raise ValueError("blocking by category needs a category column")
    # Keys cost far more than the bytes of their rows tell: they are worked out by many tasks, even of one small file.
    records = records.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = records.withColumn("key", comparison_key(F.col(f"`{value}`").cast("string"), tables))
    parts: dict[str, Column] = {
        "prefix": F.substring(F.replace(F.col("key"), F.lit(" "), F.lit("")), 1, prefix_length),
        "brand": comparison_key(F.col(f"`{brand}`").cast("string"), tables) if brand else F.substring_index("key", " ", 1),
        "category": comparison_key(F.col(f"`{category}`").cast("string"), tables) if category else F.lit(""),
    }
    missing = F.col("key") == ""
    for s in strategy:
        missing = missing | (parts[s] == "")
    return keyed.withColumn("block", F.when(missing, UNBLOCKED).otherwise(F.concat_ws("|", *[parts[s] for s in strategy])))


def all_pairs_count(n: int) -> int:
    return n * (n - 1) // 2


def pair_count(blocked: DataFrame, include_unblocked: bool = False) -> DataFrame:
    """One row, pair_count: what candidate_pairs would give, without making it."""
    rows = blocked if include_unblocked else blocked.where(F.col("block") != UNBLOCKED)
    return rows.groupBy("block").count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0)).cast("long").alias("pair_count"))


def candidate_pairs(blocked: DataFrame, include_unblocked: bool = False, idx: str = "idx", tile_rows: int = 2048) -> DataFrame:
    """Pairs within blocks, the smaller idx left; a row without idx is in none.

    Keys are worked out once, into a table, before anything filters by them.  The
    rows of a block are dealt by idx into tiles of about tile_rows, and each two
    tiles of a block meet in one task's share, so that no block is the work of one
    task, however few bytes it has.  A block of n rows gives n(n-1)/2 pairs, which
    pair_count tells beforehand.
    """
    if tile_rows < 1:
        raise ValueError("tile_rows must be at least 1")
    rows = written(blocked.select("block", idx, "value", "key"), "blocked").where(F.col(idx).isNotNull())
    rows = rows if include_unblocked else rows.where(F.col("block") != UNBLOCKED)
    sizes = rows.groupBy("block").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("_tiles"))
    dealt = rows.join(sizes, "block").withColumn("_tile", F.pmod(F.xxhash64(idx), F.col("_tiles")).cast("int"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: by bytes, few tasks would get all pairs

    def side(name: str, p: Column, q: Column) -> DataFrame:
        own = dealt.select("block", p.alias("_p"), q.alias("_q"), *[F.col(c).alias(f"_{name}_{c}") for c in (idx, "value", "key")])
        return own.repartition(parts, "block", "_p", "_q")

    a = side("a", F.col("_tile"), F.explode(F.sequence("_tile", F.col("_tiles") - 1)))
    b = side("b", F.explode(F.sequence(F.lit(0), F.col("_tile"))), F.col("_tile"))
    ordered = F.col(f"_a_{idx}") < F.col(f"_b_{idx}")
    # Rows of one idx are in one tile: those of two tiles differ in it.
    met = a.join(b.hint("merge"), ["block", "_p", "_q"]).where((F.col("_p") < F.col("_q")) | ordered)
    pick = lambda c, x, y: F.when(ordered, F.col(f"_{x}_{c}")).otherwise(F.col(f"_{y}_{c}"))
    return met.select("block", *[pick(c, *xy).alias(f"{name}_{c}") for name, xy in (("left", "ab"), ("right", "ba")) for c in (idx, "value", "key")])


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity within 0 and 1; 0 for a vector without length; NULL if the lengths differ or a component is NULL."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    size = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    both = F.transform(F.array(F.struct(dot.alias("dot"), size.alias("size"))), lambda m: F.when(m["dot"].isNull(), None).when(m["size"] == 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), m["dot"] / m["size"]))))
    return F.when(F.size(a) == F.size(b), both[0])


def classify(pairs: DataFrame, thresholds: Thresholds | None = None, known: Column | None = None) -> DataFrame:
    """pairs (with similarity) with decision, status, source and grey; where known is false nothing is said."""
    t = thresholds or Thresholds()
    known = F.lit(True) if known is None else known
    s = F.col("similarity")
    return pairs.withColumns({
        "decision": F.when(~known, "undecided").when(s >= t.high, "same").when(s < t.low, "different").otherwise("undecided"),
        "status": F.when(known & ((s >= t.high) | (s < t.low)), "auto").otherwise("review"),
        "source": F.when(known, "embedding").otherwise("none"),
        "grey": known & (s < t.high) & (s >= t.low),
    })


def grey_ratio(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.coalesce(F.avg(F.col("grey").cast("int")), F.lit(0.0)).alias("grey_ratio"))


Embedder = Callable[[list[str]], list[list[float]]]


def hashed_ngrams(texts: list[str], dim: int = 256, n: int = 3) -> list[list[float]]:
    """An embedder without a model: counts of character n-grams, hashed."""
    out = []
    for text in texts:
        v = [0.0] * dim
        marked = f" {text} "
        for i in range(max(1, len(marked) - n + 1)):
            v[int.from_bytes(hashlib.blake2b(marked[i : i + n].encode(), digest_size=4).digest(), "big") % dim] += 1.0
        out.append(v)
    return out


def embed_keys(keys: DataFrame, embedder: Embedder) -> DataFrame:
    """(key, vector) of each distinct non-empty key; batches go to the embedder on the executors."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            texts = batch["key"].tolist()
            vectors = [[float(x) for x in v] for v in embedder(texts)]
            if len(vectors) != len(texts):
                raise ValueError(f"the embedder gave {len(vectors)} vectors for {len(texts)} texts")
            yield pd.DataFrame({"key": texts, "vector": vectors})

    return keys.where("key <> ''").select("key").distinct().mapInPandas(run, "key string, vector array<double>")


def check_vectors(vectors: DataFrame) -> None:
    """Refuse vectors that are empty, of different lengths, or have a component that is no number."""
    v = F.col("vector")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    low, high, wrong = vectors.agg(F.min(F.size(v)), F.max(F.size(v)), F.bool_or(F.coalesce(odd, F.lit(True)))).first()
    if low is not None and (low != high or low < 1 or wrong):
        raise ValueError("the embedder must give one non-empty vector of numbers for each text, all of one length")


def score_pairs(pairs: DataFrame, blocked: DataFrame, embedder: Embedder = hashed_ngrams, thresholds: Thresholds | None = None) -> DataFrame:
    """pairs with similarity, decision, status, source and grey; a pair with an empty key is left to a person."""
    vectors = written(embed_keys(blocked, embedder), "vectors")
    check_vectors(vectors)
    left = vectors.select(F.col("key").alias("left_key"), F.col("vector").alias("left_vector"))
    right = vectors.select(F.col("key").alias("right_key"), F.col("vector").alias("right_vector"))
    joined = pairs.join(left, "left_key", "left").join(right, "right_key", "left")
    known = F.col("left_vector").isNotNull() & F.col("right_vector").isNotNull()
    scored = joined.withColumn("similarity", F.when(known, cosine(F.col("left_vector"), F.col("right_vector"))).otherwise(0.0))
    return classify(scored, thresholds, known).drop("left_vector", "right_vector")


def http_embedder(url: str, model: str, key: str | None = None, timeout: float = 120) -> Embedder:
    """An embeddings endpoint that takes {"model", "input"}: answers with data[].embedding or embeddings[]."""

    def embed(texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(url, json.dumps({"model": model, "input": texts}).encode(), headers)
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            got = json.load(answer)
        return got["embeddings"] if "embeddings" in got else [x["embedding"] for x in got["data"]]

    return embed


ADVICE_PROMPT = (
    "Say whether two descriptions name the same product. Answer with JSON only: "
    '{"same": true or false, "confidence": 0 to 1, "reason": "..."}. A person confirms every merge.'
)


def strip_fence(text: str) -> str:
    text = text.strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
    return text.strip()


def parse_advice(answer: str, floor: float = 0.5) -> tuple[str, float | None, str | None]:
    """(suggestion, confidence, reason); anything but a well-formed, confident answer is undecided."""
    try:
        doc = json.loads(strip_fence(answer))
        same, confidence, reason = doc["same"], doc["confidence"], doc["reason"]
    except (ValueError, KeyError, TypeError):
        return "undecided", None, "the answer was not understood"
    sound = isinstance(same, bool) and isinstance(confidence, (int, float)) and not isinstance(confidence, bool) and 0 <= confidence <= 1
    if not sound or not isinstance(reason, str) or not reason.strip():
        return "undecided", None, "the answer was not understood"
    return ("undecided" if confidence < floor else "same" if same else "different"), float(confidence), reason


def advise(decisions: DataFrame, complete: Callable[[str, str], str], thresholds: Thresholds | None = None) -> DataFrame:
    """decisions with suggestion, confidence and advice for grey pairs, however many; their status stays review.

    Executors make the calls, one for each pair, and their answers are written
    before anything reads them, so that no pair is asked about twice.
    """
    floor = (thresholds or Thresholds()).advice_floor

    def run(batches):
        import pandas as pd

        for batch in batches:
            said = []
            for left, right in zip(batch["left_value"], batch["right_value"]):
                try:
                    said.append(parse_advice(complete(ADVICE_PROMPT, json.dumps([left, right], ensure_ascii=False)), floor))
                except Exception as e:  # a provider may fail in any way; the pair then waits for a person
                    said.append(("undecided", None, f"no answer: {e}"))
            suggestion, confidence, advice = zip(*said) if said else ((), (), ())
            yield pd.DataFrame({"left_idx": batch["left_idx"], "right_idx": batch["right_idx"], "suggestion": suggestion, "confidence": pd.Series(confidence, dtype="float64"), "advice": advice})

    kinds = {f.name: f.dataType.simpleString() for f in decisions.schema.fields}
    schema = f"left_idx {kinds['left_idx']}, right_idx {kinds['right_idx']}, suggestion string, confidence double, advice string"
    grey = decisions.where("grey").select("left_idx", "right_idx", "left_value", "right_value")
    said = written(grey.mapInPandas(run, schema), "advice")
    return decisions.join(said, ["left_idx", "right_idx"], "left")


def resolve_pairs(blocked: DataFrame, embedder: Embedder = hashed_ngrams, complete: Callable[[str, str], str] | None = None,
                  thresholds: Thresholds | None = None, include_unblocked: bool = True) -> DataFrame:
    """Candidate pairs, scored, and advised on if there is somebody to ask."""
    decisions = written(score_pairs(candidate_pairs(blocked, include_unblocked), blocked, embedder, thresholds), "decisions")
    return advise(decisions, complete, thresholds) if complete else decisions


def cluster_members(decisions: DataFrame) -> DataFrame:
    """(idx, root) of every record that is in a pair; root is the least idx that it is joined to."""
    sure = decisions.where((F.col("decision") == "same") & (F.col("status") == "auto")).select("left_idx", "right_idx")
    joined = components(sure).select(F.col("node").alias("idx"), F.col("component").alias("root"))
    paired = decisions.select(F.col("left_idx").alias("idx")).union(decisions.select("right_idx")).distinct()
    return paired.join(joined, "idx", "left").select("idx", F.coalesce("root", "idx").alias("root"))


def elect(members: DataFrame) -> DataFrame:
    """(root, canonical): of the most rows, then the shortest, then the first in code-point order."""
    rank = F.struct(-F.col("row_count"), F.char_length("value"), F.col("value"))
    return members.groupBy("root").agg(F.min_by("value", rank).alias("canonical"))


def cluster_plan(decisions: DataFrame, records: DataFrame, column: str) -> Clusters:
    """Clusters for review: components of sure links, with doubtful neighbours as candidates."""
    key = F.col("key") if "key" in records.columns else F.lit(None).cast("string")
    known = records.select("idx", "value", "row_count", key.alias("key"))
    members = written(cluster_members(decisions).join(known, "idx"), "members")
    side = lambda name: members.select(F.col("idx").alias(f"{name}_idx"), F.col("root").alias(f"{name}_root"))
    extra = [c for c in ("suggestion", "confidence", "advice") if c in decisions.columns]
    doubt = decisions.where(F.col("status") == "review").join(side("left"), "left_idx").join(side("right"), "right_idx")
    inner = doubt.where("left_root = right_root").select(F.col("left_root").alias("root")).distinct()
    own_left = F.col("left_root") < F.col("right_root")
    outer = doubt.where("left_root <> right_root").select(
        F.least("left_root", "right_root").alias("root"),
        F.when(own_left, F.col("right_value")).otherwise(F.col("left_value")).alias("value"),
        "similarity", "source", F.struct("block", "left_idx", "right_idx").alias("at"), *extra,
    ).where(bare(F.col("value")) != "")
    best = Window.partitionBy("root", "value").orderBy(F.desc("similarity"), "at")
    outer = outer.withColumn("n", F.row_number().over(best)).where("n = 1")
    grouped = members.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("idx", "value", "row_count", "key"))).alias("members"))
    candidates = outer.groupBy("root").agg(F.collect_list(F.struct(-F.col("similarity"), "value", "source", *extra)).alias("candidates"))
    plan = (
        grouped.join(elect(members), "root").join(candidates, "root", "left").join(inner.withColumn("inner", F.lit(True)), "root", "left")
        .where((F.size("members") >= 2) | F.col("candidates").isNotNull()).orderBy("root")
    )
    out = []
    for i, row in enumerate(plan.toLocalIterator(), 1):
        found = sorted(row["candidates"] or [], key=lambda c: (c[0], c[1]))
        status = "review" if found or row["inner"] else "auto"
        reason = f"{len(row['members'])} values, {len(found)} doubtful" + (", a doubtful link inside" if row["inner"] else "")
        out.append(Cluster(
            f"c{i:03d}", column, row["canonical"], status, [ClusterMember(m["value"], m["row_count"], m["key"]) for m in row["members"]],
            [ClusterCandidate(c["value"], -c[0], (c.asDict().get("suggestion") or "undecided"), c["source"], c.asDict().get("confidence"), c.asDict().get("advice")) for c in found],
            reason,
        ))
    return Clusters(out)
