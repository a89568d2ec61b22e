"""Formats of hypergraph files: Parquet folders, JSON records, hMETIS text and HIF.

A file is read into tables: ``edges`` (as ``polyad.operators.edges`` describes) and ``nodes``. Compressed
files (.gz and the like) are read by Spark's codecs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.errors import InvalidFileTypeError, InvalidFormatError, InvalidParameterError, StorageError
from polyad.operators.edges import kind_of, node_table, upsert
from polyad.runtime import exists

TYPES = {"undirected": "Hypergraph", "directed": "DirectedHypergraph", "temporal": "TemporalHypergraph", "multiplex": "MultiplexHypergraph"}
HIF_TYPES = {"undirected": "undirected", "directed": "directed"}
META = "map<string,string>"


@dataclass
class Stored:
    """What a file holds."""

    edges: DataFrame
    nodes: DataFrame
    kind: str = "undirected"
    weighted: bool = True
    meta: dict = field(default_factory=dict)


def _nodes_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return node_table(edges, nodes).join(nodes, "node", "left")


# -- Parquet


def write_parquet(stored: Stored, path: str) -> None:
    """A folder with ``edges``, ``nodes`` and a manifest; the form to keep data in."""
    stored.edges.write.mode("errorifexists").parquet(f"{path}/edges")
    stored.nodes.write.mode("errorifexists").parquet(f"{path}/nodes")
    manifest = json.dumps({"kind": stored.kind, "weighted": stored.weighted, "meta": stored.meta})
    stored.edges.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def read_parquet(spark: SparkSession, path: str) -> Stored:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return Stored(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes"), manifest["kind"], manifest["weighted"], manifest["meta"])


# -- JSON records


def read_json(spark: SparkSession, path: str, *, node_type: str = "bigint") -> Stored:
    """One JSON array of records, or one record per line: a header, ``type: node`` and ``type: edge``.

    Weight, time and layer are read from an edge's metadata; what else is there stays metadata.
    """
    lines = spark.read.text(path)
    first = lines.where(F.length(F.trim("value")) > 0).first()
    schema = "hypergraph_type string, hypergraph_metadata string, type string, idx string, interaction string, metadata string"
    array = first is not None and first.value.lstrip().startswith("[")
    try:
        rows = spark.read.schema(schema).option("multiLine", array).json(path) if first is not None else spark.createDataFrame([], schema)
        rows = rows.withColumn("seq", F.monotonically_increasing_id())
        head = rows.where("hypergraph_type IS NOT NULL").select("hypergraph_type", "hypergraph_metadata").first()
    except Exception as e:
        raise InvalidFormatError(f"{path}: {str(e)[:200]}") from e
    if head is None:
        raise InvalidFormatError(f"{path} has no record with hypergraph_type")
    kinds = {v: k for k, v in TYPES.items()}
    if head.hypergraph_type not in kinds:
        raise InvalidFormatError(f"{path}: unknown hypergraph_type {head.hypergraph_type!r}")
    kind, meta = kinds[head.hypergraph_type], json.loads(head.hypergraph_metadata or "{}")
    weighted = bool(meta.get("weighted", True))
    own = F.from_json("metadata", META)
    edges = rows.where("type = 'edge'").select("seq", "interaction", own.alias("meta"))
    columns = ["seq", F.when(F.lit(weighted), F.element_at("meta", "weight").cast("double")).alias("weight"), F.map_filter("meta", lambda k, v: ~k.isin("weight", "time", "layer")).alias("meta")]
    if kind == "directed":
        sides = F.from_json("interaction", f"array<array<{node_type}>>")
        columns += [sides[0].alias("src"), sides[1].alias("tgt")]
    else:
        columns.append(F.from_json("interaction", f"array<{node_type}>").alias("nodes"))
    if kind == "temporal":
        columns.append(F.element_at("meta", "time").cast("bigint").alias("time"))
    if kind == "multiplex":
        columns.append(F.element_at("meta", "layer").alias("layer"))
    table = upsert(edges.select(*columns), kind=kind, duplicate="accumulate_weight" if weighted else "ignore", weighted=weighted)
    nodes = rows.where("type = 'node'").select(F.col("idx").cast(node_type).alias("node"), own.alias("meta")).where("node IS NOT NULL")
    nodes = nodes.groupBy("node").agg(F.first("meta", ignorenulls=True).alias("meta"))
    return Stored(table, _nodes_of(table, nodes), kind, weighted, meta)


def write_json(stored: Stored, path: str, *, array: bool = False) -> None:
    """A folder of JSON lines: the header, every node and every edge, with weight, time and layer in the metadata.

    ``array``: one file that holds one array instead, written through by one task.
    """
    spark = stored.edges.sparkSession
    head = {"hypergraph_type": TYPES[stored.kind], "hypergraph_metadata": {**stored.meta, "weighted": stored.weighted}}
    lines = spark.createDataFrame([(json.dumps(head),)], "value string")
    nodes = stored.nodes if "meta" in stored.nodes.columns else stored.nodes.withColumn("meta", F.lit(None).cast(META))
    lines = lines.unionByName(nodes.select(F.to_json(F.struct(F.lit("node").alias("type"), F.col("node").alias("idx"), F.coalesce(F.col("meta"), F.create_map().cast(META)).alias("metadata"))).alias("value")))
    edges = stored.edges
    own = F.create_map(*[x for c in ("weight", "time", "layer") if c in edges.columns for x in (F.lit(c), F.col(c).cast("string"))])
    if "meta" in edges.columns:
        kept = dict(edges.dtypes)["meta"]
        extra = F.col("meta") if kept == META else F.transform_values("meta", lambda k, v: F.array_join(v, ","))
        own = F.map_concat(F.map_filter(F.coalesce(extra, F.create_map().cast(META)), lambda k, v: ~k.isin("weight", "time", "layer")), own)
    members = F.array("src", "tgt") if stored.kind == "directed" else F.col("nodes")
    lines = lines.unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("type"), members.alias("interaction"), own.alias("metadata"))).alias("value")))
    if array:
        first = F.col("value").startswith('{"hypergraph_type"')
        rows = lines.select(F.when(first, 0).otherwise(1).alias("section"), F.concat(F.when(first, F.lit("[")).otherwise(F.lit(",")), F.col("value")).alias("value"))
        return _one_file(rows.unionByName(spark.createDataFrame([(2, "]")], "section int, value string")), path)
    lines.write.text(path)


def _one_file(rows: DataFrame, path: str) -> None:
    """The lines ``value`` in the order of ``section`` in one file: one task sorts and writes, on disk where they are many."""
    rows.coalesce(1).sortWithinPartitions("section").select("value").write.text(path)


# -- hMETIS text


def read_hgr(spark: SparkSession, path: str) -> Stored:
    """hMETIS: ``%`` comments, a header "edges nodes [mode]", one edge per line; mode % 10 = 1 has weights first.

    Lines of node weights after the edges are read over. Too few or too many lines are an error.
    """
    rows = spark.read.text(path).select(F.trim("value").alias("line")).where(~F.col("line").startswith("%") & (F.length("line") > 0)).coalesce(1)
    rows = rows.withColumn("at", F.monotonically_increasing_id())  # lines have an order only within one file
    head = rows.where("at = 0").first()
    try:
        numbers = [int(x) for x in head.line.split()]
        n_edges, n_nodes = numbers[:2]
    except (AttributeError, ValueError) as e:
        raise InvalidFormatError(f"{path} has no header of two numbers") from e
    mode = numbers[2] if len(numbers) > 2 else 0
    weighted, node_weights = mode % 10 == 1, mode // 10 == 1
    wanted = n_edges + (n_nodes if node_weights else 0)
    if (found := rows.count() - 1) != wanted:
        raise InvalidFormatError(f"{path} has {found} lines after the header, not {wanted}")
    ints = F.transform(F.split("line", r"\s+"), lambda x: x.cast("bigint"))
    lines = rows.where(F.col("at").between(1, n_edges)).select(F.col("at").alias("seq"), ints.alias("x"))
    members = F.expr("slice(x, 2, greatest(size(x) - 1, 0))") if weighted else F.col("x")
    weight = F.col("x")[0].cast("double") if weighted else F.lit(1.0)
    edges = upsert(lines.select("seq", members.alias("nodes"), weight.alias("weight")))
    nodes = spark.range(1, n_nodes + 1).select(F.col("id").alias("node"), F.lit(None).cast(META).alias("meta"))
    return Stored(edges, nodes, weighted=weighted)


def write_hgr(stored: Stored, path: str) -> None:
    """hMETIS text of an undirected hypergraph whose nodes are 1..n; in one file, written through by one task."""
    edges = stored.edges
    n, top = edges.count(), node_table(edges, stored.nodes).agg(F.max("node")).first()[0] or 0
    if stored.kind != "undirected":
        raise InvalidParameterError("hgr is for undirected hypergraphs")
    line = F.concat_ws(" ", *([F.col("weight").cast("bigint").cast("string")] if stored.weighted else []), F.array_join(F.col("nodes").cast("array<string>"), " "))
    head = edges.sparkSession.createDataFrame([(-1, f"{n} {top}" + " 1" * stored.weighted)], "section bigint, value string")
    _one_file(head.unionByName(edges.select(F.col("edge_id").alias("section"), line.alias("value"))), path)


# -- HIF


HIF = "`network-type` string, metadata string, incidences array<struct<edge:string,node:string,weight:double,direction:string,attrs:string>>, nodes array<struct<node:string,weight:double,attrs:string>>, edges array<struct<edge:string,weight:double,attrs:string>>"


def incidence_edges(incidences: DataFrame, edges: DataFrame | None = None, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges from rows (``edge``, ``node`` and maybe ``direction``, ``weight``): ``name``, members, weight; named empty edges; nodes.

    Directed if some direction is head or tail: tails are sources, heads targets. Rows without edge or node are left out.
    """
    known = incidences.where("edge IS NOT NULL AND node IS NOT NULL")
    directed = "direction" in known.columns and not known.where("direction IN ('head', 'tail')").isEmpty()
    if directed:
        side = lambda d: F.array_sort(F.collect_set(F.when(F.col("direction") == d, F.col("node"))))
        members = known.groupBy("edge").agg(side("tail").alias("src"), side("head").alias("tgt"))
    else:
        members = known.groupBy("edge").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    empty = members.select("edge").limit(0)
    if edges is not None:
        members = members.join(edges.groupBy("edge").agg(F.first("weight", ignorenulls=True).alias("weight")) if "weight" in edges.columns else edges.select("edge").distinct(), "edge", "left")
        empty = edges.select("edge").where("edge IS NOT NULL").distinct().join(known.select("edge"), "edge", "left_anti")
    every = known.select("node") if nodes is None else known.select("node").unionByName(nodes.select("node").where("node IS NOT NULL"))
    return members, empty, every.distinct()


def read_hif(spark: SparkSession, path: str) -> tuple[Stored, DataFrame]:
    """The hypergraph of a HIF file, and its named edges without incidences. Nodes keep their names, as text."""
    rows = spark.read.schema(HIF).option("multiLine", True).json(path)
    part = lambda name: rows.select(F.explode(name).alias("x")).select("x.*")  # noqa: E731 (entries without a name are left out further on)
    if rows.where("incidences IS NOT NULL").isEmpty():
        raise InvalidFormatError(f"{path} has no incidences")
    members, empty, nodes = incidence_edges(part("incidences"), part("edges"), part("nodes"))
    kind = "directed" if "src" in members.columns else "undirected"
    edges = upsert(members.withColumn("seq", F.xxhash64("edge")).drop("edge"), kind=kind)
    attrs = part("nodes").select("node", F.from_json("attrs", META).alias("meta")).groupBy("node").agg(F.first("meta", ignorenulls=True).alias("meta"))
    return Stored(edges, nodes.join(attrs, "node", "left"), kind), empty


def write_hif(stored: Stored, path: str) -> None:
    """One HIF document. The format is one JSON object, so one task writes its lines through; none is held in memory."""
    if stored.kind not in HIF_TYPES:
        raise InvalidParameterError("HIF holds undirected and directed hypergraphs")
    spark, text = stored.edges.sparkSession, lambda c: F.col(c).cast("string")
    sides = [("src", "tail"), ("tgt", "head")] if stored.kind == "directed" else [("nodes", None)]
    incidences = None
    for column, direction in sides:
        held = stored.edges.select("edge_id", F.explode(column).alias("node"))
        part = held.select(F.to_json(F.struct(text("edge_id").alias("edge"), text("node").alias("node"), *([F.lit(direction).alias("direction")] if direction else []))).alias("value"))
        incidences = part if incidences is None else incidences.unionByName(part)
    attrs = [F.when(F.size("meta") > 0, F.col("meta")).alias("attrs")] if "meta" in stored.nodes.columns else []
    nodes = stored.nodes.select(F.to_json(F.struct(text("node").alias("node"), *attrs)).alias("value"))
    edges = stored.edges.select(F.to_json(F.struct(text("edge_id").alias("edge"), "weight")).alias("value"))
    head = json.dumps({"network-type": HIF_TYPES[stored.kind], "metadata": stored.meta})[:-1]
    lines = spark.createDataFrame([(0, f'{head}, "incidences": [{{}}'), (2, '], "nodes": [{}'), (4, '], "edges": [{}'), (6, "]}")], "section int, value string")
    for section, part in ((1, incidences), (3, nodes), (5, edges)):
        lines = lines.unionByName(part.select(F.lit(section).alias("section"), F.concat(F.lit(","), "value").alias("value")))
    _one_file(lines, path)


# -- facade


def read_hypergraph(spark: SparkSession, path: str, *, fmt: str | None = None, **options) -> Stored:
    """Read by ``fmt`` or the file's ending: .json or .jsonl, .hgr, .hif, or a Parquet folder."""
    name = path.removesuffix(".gz").rstrip("/")
    fmt = fmt or {"json": "json", "jsonl": "json", "hgr": "hgr", "hif": "hif", "parquet": "parquet"}.get(name.rpartition(".")[2])
    readers = {"json": read_json, "hgr": read_hgr, "parquet": read_parquet, "hif": lambda s, p, **o: read_hif(s, p, **o)[0]}
    if fmt not in readers:
        raise InvalidFileTypeError(f"{path}: the format is json, hgr, hif or parquet; pickled objects are not read, for they run code")
    return readers[fmt](spark, path, **options)


def write_hypergraph(stored: Stored, path: str, *, fmt: str = "parquet", **options) -> None:
    writers = {"json": write_json, "hgr": write_hgr, "hif": write_hif, "parquet": write_parquet}
    if fmt not in writers:
        raise InvalidFileTypeError(f"unknown format: {fmt}")
    writers[fmt](stored, path, **options)


#: Endings that a data set without one is looked for with, in this order; each also compressed.
ENDINGS = ("json", "hgr", "hif", "parquet")


def read_remote(spark: SparkSession, name: str, *, base: str | None = None, allow_network: bool = False, fmt: str | None = None) -> Stored:
    """A named data set under the address ``base``, any file system that Spark reads. Off unless ``allow_network`` is given.

    A name without an ending is looked for as json first, then in the other formats, plain or with .gz.
    """
    if not allow_network:
        raise InvalidParameterError("remote data sets are read only with allow_network=True")
    if not base:
        raise InvalidParameterError("base, the address of the data sets, is not given")
    path = f"{base.rstrip('/')}/{name}"
    if fmt is None and not name.removesuffix(".gz").endswith(tuple(f".{e}" for e in ENDINGS)):
        tried = [f"{path}.{e}{z}" for e in ENDINGS for z in ("", ".gz")]
        found = [p for p in tried if exists(spark, p)]
        if not found:
            raise StorageError(f"none of these is there: {', '.join(tried)}")
        path = found[0]
    return read_hypergraph(spark, path, fmt=fmt)


def content_hash(stored: Stored) -> str:
    """SHA-256 of the content: kind, weights, nodes and edges with their metadata, whatever their order and ids.

    Rows are hashed where they are. Each hash is eight numbers of 32 bits, whose sums over all rows are
    hashed in turn: nothing but eight sums is ever brought together.
    """
    edges = stored.edges
    fields = [F.to_json(F.struct(*[F.col(c) for c in ("src", "tgt", "nodes", "time", "layer") if c in edges.columns])), F.format_string("%.9e", F.col("weight"))]
    meta = lambda df: F.coalesce(F.to_json(F.array_sort(F.map_entries("meta"))), F.lit("")) if "meta" in df.columns else F.lit("")
    rows = edges.select(F.sha2(F.concat_ws("\x1f", F.lit("e"), *fields, meta(edges)), 256).alias("h"))
    rows = rows.unionByName(stored.nodes.select(F.sha2(F.concat_ws("\x1f", F.lit("n"), F.col("node").cast("string"), meta(stored.nodes)), 256).alias("h")))
    lanes = [F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(8)]
    sums = [F.coalesce(F.col(f"s{k}"), F.lit(0)).cast("decimal(38,0)").cast("string") for k in range(8)]
    return rows.agg(*lanes).select(F.sha2(F.concat_ws(":", F.lit(f"{kind_of(edges)} {str(stored.weighted).lower()}"), *sums), 256)).first()[0]
