"""Near-duplicate vectors by product quantisation.

Vectors go to inverted lists around coarse centroids; a residual is stored as one
codeword per subspace, with the exact length of what the codes leave out.  A vector
probes its nearest lists, less those which the distance to the bisecting plane proves
empty of partners.  Distances come from a table per query and subspace; with the stored
length, a candidate is passed over only if the triangle inequality rules it out.
Candidates are ranked by the exact cosine in double precision, so no link is wrong.

Bounds: the coarse centroids and codebooks are fitted on at most ``sample`` vectors
(``SAMPLE_PER_LIST`` for each list, ``MAX_LISTS`` lists); all vectors are indexed.  Lists
are dealt to blocks of ``BLOCK`` rows, and a task compares one block of queries with one
block of members, so a list may hold any share of the rows.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components link with nothing.  Equal vectors are one member with a count.  A null id
links with nothing; an empty table gives an empty result.  Only the named columns are
used.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civilspark.llm.common import components
from civilspark.session import materialise

MAX_LISTS = 4096
SAMPLE_PER_LIST = 32
LEAST_SAMPLE = 20_000
CODEWORDS = 256
PROBES = 12
BLOCK = 2048
SEED = 7


@dataclass(frozen=True)
class Model:
    centroids: np.ndarray  # (lists, d)
    codebooks: np.ndarray  # (subspaces, codewords, d / subspaces)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances to all centroids."""
    return np.maximum(
        (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)[None], 0
    )


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Lloyd's algorithm; k is cut to the number of distinct points."""
    x = np.asarray(x, np.float32)
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    k = min(k, len(distinct))
    centroids = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        home = np.concatenate(
            [_nearest(part, centroids).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))]
        )
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        counts = np.bincount(home, minlength=k)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids.astype(np.float32)


def fit(sample: np.ndarray, lists: int) -> Model:
    """Coarse centroids and residual codebooks of unit vectors."""
    d = sample.shape[1]
    centroids = kmeans(sample, lists)
    home = np.concatenate(
        [_nearest(p, centroids).argmin(1) for p in np.array_split(sample, max(1, len(sample) // 4096))]
    )
    residuals = sample - centroids[home]
    spaces = next(m for m in (8, 4, 2, 1) if d % m == 0)
    width = d // spaces
    books = []
    for space in range(spaces):
        book = kmeans(residuals[:, space * width : (space + 1) * width], CODEWORDS, seed=space)
        books.append(np.resize(book, (CODEWORDS, width)))  # repeats if there are fewer
    return Model(centroids, np.stack(books).astype(np.float32))


def _units(data) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)
    return raw, raw / np.linalg.norm(raw, axis=1)[:, None]


def _codes(units: np.ndarray, home: np.ndarray, model: Model):
    residuals = units - model.centroids[home]
    spaces, _, width = model.codebooks.shape
    codes = np.empty((len(units), spaces), np.uint8)
    approx = np.empty_like(residuals)
    for space in range(spaces):
        part = slice(space * width, (space + 1) * width)
        codes[:, space] = _nearest(residuals[:, part], model.codebooks[space]).argmin(1)
        approx[:, part] = model.codebooks[space][codes[:, space]]
    return codes, np.linalg.norm(residuals - approx, axis=1)


def _classes(vectors: DataFrame) -> DataFrame:
    """``(vec_id, sig, vec)``; ``vec`` holds doubles and is null if it links with nothing."""

    def read(batches):
        for batch in batches:
            sigs, out = [], []
            for value in batch["v"]:
                sig = data = None
                if value is not None and len(value):
                    x = np.array([np.nan if c is None else c for c in value], np.float64)
                    with np.errstate(over="ignore", invalid="ignore"):
                        usable = np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf
                    if usable:
                        data = (x + 0.0).tobytes()
                        sig = hashlib.md5(data, usedforsecurity=False).digest()
                sigs.append(sig)
                out.append(data)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "sig": sigs, "vec": out})

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInPandas(read, f"vec_id {kind}, sig binary, vec binary")


def links(members: DataFrame, n: int, threshold: float, probes: int = PROBES) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of ``members(id, vec)`` with the cosine."""
    spark = members.sparkSession
    lists = max(1, min(MAX_LISTS, 4 * math.isqrt(n)))
    wanted = max(LEAST_SAMPLE, SAMPLE_PER_LIST * lists)
    share = min(1.0, wanted / max(1, n))
    chosen = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)
    sample = [r.vec for r in members.where(chosen).select("vec").limit(2 * wanted).collect()]
    model = fit(_units(sample)[1].astype(np.float32), lists)
    shared = spark.sparkContext.broadcast(model)
    radius = math.sqrt(2 - 2 * threshold) + 1e-6

    def encode(batches):
        model = shared.value
        between = np.sqrt(_nearest(model.centroids, model.centroids)) if len(model.centroids) < 5000 else None
        for batch in batches:
            if not len(batch):
                continue
            _, units = _units(batch["vec"])
            far = _nearest(units.astype(np.float32), model.centroids)
            home = far.argmin(1)
            codes, left = _codes(units, home, model)
            near = np.argsort(far, axis=1, kind="stable")[:, :probes]
            rows = np.arange(len(units))[:, None]
            # distance to the plane between the home centroid and the other one
            gap = between[home[:, None], near]
            plane = (far[rows, near] - far[rows, home[:, None]]) / np.maximum(2 * gap, 1e-12)
            open_lists = (plane <= radius + 1e-4) | (near == home[:, None])
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "vec": batch["vec"],
                    "home": home,
                    "codes": [c.tobytes() for c in codes],
                    "left": left,
                    "probes": [p[o] for p, o in zip(near, open_lists)],
                }
            )

    kind = members.schema["id"].dataType.simpleString()
    coded = members.mapInPandas(
        encode, f"id {kind}, vec binary, home int, codes binary, `left` double, probes array<int>"
    )
    coded = materialise(coded, "coded")
    queries = coded.select("id", "vec", F.explode("probes").alias("home"))
    blocks = (
        coded.groupBy("home")
        .agg(F.count(F.lit(1)).alias("m"))
        .join(queries.groupBy("home").agg(F.count(F.lit(1)).alias("q")), "home")
        .select(
            "home",
            F.ceil(F.col("m") / BLOCK).alias("m_blocks"),
            F.ceil(F.col("q") / BLOCK).alias("q_blocks"),
        )
    )
    blocks = F.broadcast(blocks)  # one row per list, MAX_LISTS at most

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its block, repeated for every block of the other side."""
        rows = rows.join(blocks, "home")
        rows = rows.withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")))
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}_blocks") - 1))
        return rows.withColumn(other, each).drop("m_blocks", "q_blocks")

    def compare(asked, held):
        empty = pd.DataFrame({"a": [], "b": []})
        if not len(asked) or not len(held):
            return empty
        model = shared.value
        raw_q, units = _units(asked["a_vec"])
        raw_m, _ = _units(held["h_vec"])
        codes = np.frombuffer(b"".join(held["h_codes"]), np.uint8).reshape(len(held), -1)
        residuals = (units - model.centroids[int(held["h_home"].iloc[0])]).astype(np.float32)
        limit = (radius + held["h_left"].to_numpy() + 1e-4) ** 2
        ids_q, ids_m = asked["a_id"].to_numpy(), held["h_id"].to_numpy()
        norms_q, norms_m = np.linalg.norm(raw_q, axis=1), np.linalg.norm(raw_m, axis=1)
        spaces, _, width = model.codebooks.shape
        found = []
        for start in range(0, len(asked), 256):
            rows = slice(start, start + 256)
            guess = np.zeros((len(residuals[rows]), len(held)), np.float32)
            for space in range(spaces):
                part = residuals[rows, space * width : (space + 1) * width]
                guess += _nearest(part, model.codebooks[space])[:, codes[:, space]]
            q, m = np.nonzero((guess <= limit) & (ids_q[rows, None] < ids_m[None]))
            q = q + start
            for at in range(0, len(q), 50_000):
                i, j = q[at : at + 50_000], m[at : at + 50_000]
                cosine = np.einsum("ij,ij->i", raw_q[i], raw_m[j]) / (norms_q[i] * norms_m[j])
                good = cosine >= threshold
                found.append(pd.DataFrame({"a": ids_q[i[good]], "b": ids_m[j[good]]}))
        return pd.concat(found) if found else empty

    columns = ["home", "m", "q"]
    asked = dealt(queries, "q", "m").select("id", "vec", *columns)
    held = dealt(coded.drop("probes"), "m", "q")
    asked, held = (t.toDF(*[f"{p}_{c}" for c in t.columns]) for p, t in (("a", asked), ("h", held)))
    return (
        asked.groupBy(*[f"a_{c}" for c in columns])
        .cogroup(held.groupBy(*[f"h_{c}" for c in columns]))
        .applyInPandas(compare, f"a {kind}, b {kind}")
    )


def near_vectors(
    spark: SparkSession,
    table: DataFrame,
    threshold: float = 0.95,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    probes: int = PROBES,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"))
    rows = materialise(_classes(rows), "vectors")
    usable = rows.where("vec is not null and vec_id is not null")
    classes = usable.groupBy("sig").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")
    )
    classes = materialise(classes, "classes")
    # Vectors of different lengths have no cosine: one search per length that has two.
    lengths = classes.groupBy(F.length("vec").alias("bytes")).agg(F.count(F.lit(1)).alias("n"))
    found = spark.createDataFrame([], classes.select(F.col("id").alias("a"), F.col("id").alias("b")).schema)
    for length in lengths.where("n > 1").orderBy("bytes").collect():
        same = classes.where(F.length("vec") == length.bytes).select("id", "vec")
        found = found.union(links(same, length.n, threshold, probes))
    found = materialise(found.distinct(), "links")
    both = found.union(found.select("b", "a")).toDF("id", "other")
    sizes = classes.select(F.col("id").alias("other"), "copies")
    degrees = both.join(sizes, "other").groupBy("id").agg(F.sum("copies").alias("others"))
    joined = (
        classes.drop("vec")
        .join(degrees, "id", "left")
        .join(components(found).withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.col("sig").alias("_sig"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("_links"),
            F.coalesce("component", "id").alias("_component"),
        )
    )
    own = F.col("vec_id").isNotNull()
    return (
        rows.join(joined, F.col("sig") == F.col("_sig"), "left")
        .select(
            "vec_id",
            F.coalesce(F.when(own, F.col("_links")), F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce(F.when(own, F.col("_component")), F.col("vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
