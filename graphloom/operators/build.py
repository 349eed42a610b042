"""Graph construction: rows become nodes and typed edges, both tables.

All column rules are one projection: every record yields an array of edges that is
exploded once, so a build is one scan and one aggregation however many columns it has.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import dates, numeric
from graphloom.functions import text as tx
from graphloom.plans.lineage import cut


@dataclass
class Config:
    """Which columns play which part.  Lists and relationships map a column to its edge type."""

    id_column: str
    order_column: str
    categorical: list[str] = field(default_factory=list)
    lists: Mapping[str, str] = field(default_factory=dict)
    numeric: list[str] = field(default_factory=list)
    relationships: Mapping[str, str] = field(default_factory=dict)
    text: list[str] = field(default_factory=list)
    time_column: str | None = None
    as_of: str | None = None
    decay: float = 0.0
    confidence: Mapping[str, float] = field(default_factory=dict)
    outcome_column: str | None = None
    sentinel_zero: list[str] = field(default_factory=list)
    aliases: DataFrame | None = None


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    config: Config | None = None
    frozen: bool = False

    def kept(self) -> Graph:
        """The same graph with both tables written once, for plans that read them several times."""
        return Graph(cut(self.nodes), cut(self.edges), self.config, self.frozen)

    def ends(self) -> DataFrame:
        """Neighbour pairs, both ways, one for each edge and end."""
        e = self.edges.select("src", "dst")
        return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def __len__(self) -> int:
        return self.nodes.count()

    def __contains__(self, name: str) -> bool:
        """Whether a node has this id or label, or an entity this name."""
        return not resolve(self.nodes, name).isEmpty()

    def __iter__(self):
        """Ids of the records in order, fetched a partition at a time."""
        return (r["id"] for r in self.nodes.filter("is_record").orderBy("ord").select("id").toLocalIterator())

    def __repr__(self) -> str:
        return f"Graph({len(self)} nodes, {self.edges.count()} edges{', frozen' if self.frozen else ''})"

    def adjacency(self) -> DataFrame:
        """Distinct neighbour pairs, both ways."""
        return self.ends().distinct()

    def typed(self) -> DataFrame:
        """Every edge once for each end."""
        e = self.edges.select("src", "dst", "etype", "weight")
        return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "etype", "weight"))

    def stats(self) -> DataFrame:
        """Counts of nodes by type and of edges by type."""
        n = self.nodes.groupBy(F.lit("node").alias("what"), F.col("type").alias("kind")).agg(F.count("*").alias("n"))
        return n.unionByName(self.edges.groupBy(F.lit("edge").alias("what"), F.col("etype").alias("kind")).agg(F.count("*").alias("n")))


def as_of(df: DataFrame, time_column: str, cut: Column) -> DataFrame:
    """Rows whose time is readable and not after the cut."""
    ts = F.col(time_column) if dict(df.dtypes)[time_column].startswith("timestamp") else dates.parse(F.col(time_column))
    return df.filter(ts <= cut)


def _edge(src: Column, kind: Column | str, value: Column, etype: str, weight: Column, confidence: Column, outcome: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(src.alias("src"), kind.alias("kind"), value.cast("string").alias("label"), F.lit(etype).alias("etype"), weight.alias("weight"), confidence.alias("confidence"), outcome.alias("outcome"))


def _item_edge(me: Column, kind: str, etype: str, weight: Column, confidence: Column, outcome: Column):
    return lambda v: _edge(me, kind, v, etype, weight, confidence, outcome)


def records(df: DataFrame, c: Config) -> DataFrame:
    """Rows that make entities, with their node id."""
    if c.time_column and c.as_of:
        df = as_of(df, c.time_column, F.lit(c.as_of).cast("timestamp"))
    value = F.col(c.id_column).cast("string")
    return df.filter(value.isNotNull() & (tx.strip(value) != "")).withColumn("_node", tx.node_id("entity", value))


def projected(df: DataFrame, c: Config) -> DataFrame:
    """Every edge of every record, repeats included: src, kind, label, etype, weight, confidence, outcome, ord."""
    df = records(df, c)
    types = dict(df.dtypes)
    me = F.col("_node")
    weight = F.lit(1.0)
    if c.decay and c.time_column:
        ts = F.col(c.time_column) if types[c.time_column].startswith("timestamp") else dates.parse(F.col(c.time_column))
        weight = dates.decay(ts, F.lit(c.as_of).cast("timestamp") if c.as_of else F.current_timestamp(), c.decay)
    outcome = F.col(c.outcome_column).cast("string") if c.outcome_column else F.lit(None).cast("string")
    sure = lambda col, default: F.lit(float(c.confidence.get(col, default)))
    out = []
    for col in c.categorical:
        v = tx.strip(F.col(col))
        out.append(F.when(~tx.is_null_word(v), F.array(_edge(me, col, v, f"HAS_{col.upper()}", weight, sure(col, 1.0), outcome))))
    for col in c.numeric:
        x = F.col(col).cast("double") if types[col] in ("double", "float", "int", "bigint", "smallint", "tinyint") else numeric.parse(F.col(col))
        skip = x == 0 if col in c.sentinel_zero else F.lit(False)
        b = numeric.bucket(x)
        out.append(F.when(b.isNotNull() & ~skip, F.array(_edge(me, f"{col}_range", b, f"IN_{col.upper()}_RANGE", weight, F.lit(1.0), outcome))))
    for columns, kind in ((c.lists, None), (c.relationships, "entity")):
        for col, etype in columns.items():
            each = tx.items(F.col(col), types[col].startswith("array"))
            out.append(F.transform(each, _item_edge(me, kind or col, etype or f"HAS_{col.upper()}", weight, sure(col, 0.9), outcome)))
    for col in c.text:
        out.append(F.transform(tx.phrases(F.col(col)), lambda v: _edge(me, "concept", v, "MENTIONS", weight, F.lit(0.7), outcome)))
    none = F.array().cast("array<struct<src:string,kind:string,label:string,etype:string,weight:double,confidence:double,outcome:string>>")
    every = F.concat(*(F.coalesce(x, none) for x in out)) if out else none
    rows = df.select(F.col(c.order_column).cast("long").alias("ord"), F.explode(every).alias("e")).select("ord", "e.*")
    return tx.canonicalise(rows, "label", c.aliases) if c.aliases is not None else rows


def upsert(edges: DataFrame) -> DataFrame:
    """One edge for each pair and type, whichever way it was first stated: greatest weight and confidence, first outcome."""
    first = lambda c: F.min_by(c, "ord")
    low, high = F.least("src", "dst").alias("_low"), F.greatest("src", "dst").alias("_high")
    return edges.groupBy(low, high, "etype").agg(first("src").alias("src"), first("dst").alias("dst"), F.max("weight").alias("weight"), F.max("confidence").alias("confidence"), first("outcome").alias("outcome"), F.min("ord").alias("ord")).drop("_low", "_high")


def _edges(rows: DataFrame, c: Config) -> DataFrame:
    """Edges to features have one direction and, without outcomes, nothing to choose between: they are added up by hash.  The rest takes `upsert`."""
    rows = rows.withColumn("dst", tx.node_id(F.col("kind"), F.col("label")))
    if c.outcome_column:
        return upsert(rows)
    plain = lambda r: r.groupBy("etype", "src", "dst").agg(F.max("weight").alias("weight"), F.max("confidence").alias("confidence"), F.lit(None).cast("string").alias("outcome"), F.min("ord").alias("ord"))
    if not c.relationships:
        return plain(rows)
    return upsert(rows.filter("kind = 'entity'")).unionByName(plain(rows.filter("kind <> 'entity'")))


def build(df: DataFrame, c: Config) -> Graph:
    rows = projected(df, c)
    edges = _edges(rows, c)
    own = records(df, c).select(F.col("_node").alias("id"), F.lit("entity").alias("type"), F.col(c.id_column).cast("string").alias("label"), F.col(c.order_column).cast("long").alias("ord"), F.lit(True).alias("is_record"))
    other = rows.select(tx.node_id(F.col("kind"), F.col("label")).alias("id"), F.col("kind").alias("type"), "label", "ord", F.lit(False).alias("is_record"))
    nodes = own.unionByName(other).groupBy("id").agg(F.min_by("type", "ord").alias("type"), F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"), F.bool_or("is_record").alias("is_record"))
    return Graph(nodes, edges, c)


def add_records(g: Graph, df: DataFrame) -> Graph:
    """The graph with more records: both tables are aggregated again, so adding is the same as building at once."""
    if g.frozen:
        raise RuntimeError("the graph is frozen; call unfreeze() first")
    more = build(df, g.config)
    nodes = g.nodes.unionByName(more.nodes).groupBy("id").agg(F.min_by("type", "ord").alias("type"), F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"), F.bool_or("is_record").alias("is_record"))
    return Graph(nodes, upsert(g.edges.unionByName(more.edges)), g.config)


def add_relationship(g: Graph, source: str, etype: str, target: str, weight: float = 1.0, confidence: float = 1.0) -> Graph:
    """One more edge between entities, which are made if they are new."""
    if g.frozen:
        raise RuntimeError("the graph is frozen; call unfreeze() first")
    spark = g.nodes.sparkSession
    last = 1 << 62
    new = spark.createDataFrame([(source, last), (target, last)], "label string, ord long").select(tx.node_id("entity", F.col("label")).alias("id"), F.lit("entity").alias("type"), "label", "ord", F.lit(False).alias("is_record"))
    edge = spark.createDataFrame([(source, target, etype, weight, confidence, None, last)], "a string, b string, etype string, weight double, confidence double, outcome string, ord long")
    edge = edge.select(tx.node_id("entity", F.col("a")).alias("src"), tx.node_id("entity", F.col("b")).alias("dst"), "etype", "weight", "confidence", "outcome", "ord")
    nodes = g.nodes.unionByName(new).groupBy("id").agg(F.min_by("type", "ord").alias("type"), F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"), F.bool_or("is_record").alias("is_record"))
    return Graph(nodes, upsert(g.edges.unionByName(edge)), g.config)


def add_similarity(g: Graph, vecs: DataFrame, threshold: float = 0.7) -> Graph:
    """The graph with SIMILAR_TO edges between records whose vectors (id, embedding) have at least this cosine, which is their weight."""
    from graphloom.operators.similar import similar_pairs

    records = g.nodes.filter("is_record").select("id", "ord")
    at = cut(vecs.join(records, "id").select(F.col("ord").alias("vec_id"), "embedding", "id"))
    pairs = similar_pairs(at.select("vec_id", "embedding"), threshold)
    name = lambda side: at.select(F.col("vec_id").alias(side), F.col("id").alias(f"id_{side}"))
    found = pairs.join(name("a"), "a").join(name("b"), "b")
    edge = found.select(F.lit("SIMILAR_TO").alias("etype"), F.col("id_a").alias("src"), F.col("id_b").alias("dst"), F.round("weight", 4).alias("weight"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("outcome"), F.col("a").alias("ord"))
    return Graph(g.nodes, g.edges.unionByName(edge), g.config, g.frozen)


def build_with_similarity(df: DataFrame, c: Config, embed=None, threshold: float = 0.7) -> Graph:
    """A build, then the text columns of each record, joined by spaces, embedded and linked where similar."""
    from graphloom.operators.retrieval import hash_embedder

    joined = F.concat_ws(" ", *(F.col(x) for x in c.text))
    last = records(df, c).groupBy(F.col("_node").alias("id")).agg(F.max_by(joined, F.col(c.order_column)).alias("said"))
    return add_similarity(build(df, c), last.filter(tx.strip(F.col("said")) != "").select("id", (embed or hash_embedder)(F.col("said")).alias("embedding")), threshold)


def first_row_roles(df: DataFrame, id_column: str) -> dict[str, list[str]]:
    """Roles by the first row alone: long strings are text, strings with commas lists, other strings categorical, numbers numeric."""
    row, out = df.first(), {"categorical": [], "list": [], "numeric": [], "text": []}
    for name, kind in df.dtypes:
        value = row[name] if row else None
        if name == id_column or value is None or isinstance(value, bool):
            continue
        if isinstance(value, str):
            out["text" if len(value) > 100 else "list" if "," in value else "categorical"].append(name)
        elif kind.split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal"):
            out["numeric"].append(name)
    return out


def build_from_config(df: DataFrame, settings: dict[str, Any]) -> Graph:
    """A build from plain settings; `temporal_column` is another name of `time_column`, and unknown names are refused."""
    known = dict(settings)
    if "temporal_column" in known:
        known.setdefault("time_column", known.pop("temporal_column"))
        known.pop("temporal_column", None)
    return build(df, Config(**known))


def text_jobs(df: DataFrame, c: Config, column: str, job, min_chars: int = 20, max_chars: int = 2000) -> DataFrame:
    """src, reply: a model's reply to the head of each record's text that is long enough.

    Every partition works through its own rows, so as many calls are under way as there are running tasks;
    a call that fails gives no reply.
    """
    rows = records(df, c).select(F.col("_node").alias("src"), F.col(column).cast("string").alias("text")).filter(F.length("text") >= min_chars)

    def run(batches):
        import pandas as pd

        for p in batches:
            out = []
            for src, text in zip(p["src"], p["text"], strict=True):
                try:
                    out.append((src, job(text[:max_chars])))
                except Exception:  # one failed call is one missing reply
                    out.append((src, None))
            yield pd.DataFrame(out, columns=["src", "reply"])

    return rows.mapInPandas(run, "src string, reply string").filter("reply is not null")


def add_relations(g: Graph, replies: DataFrame, weight: float = 0.8, confidence: float = 0.7) -> Graph:
    """The graph with relations from replies (src, reply): JSON lists of {"target", "type"}; what does not parse adds nothing."""
    each = replies.select("src", F.explode(F.from_json(tx.json_part(F.col("reply")), "array<struct<target:string,type:string>>")).alias("r")).filter("r.target is not null and r.type is not null")
    edge = each.select("src", tx.node_id("entity", F.col("r.target")).alias("dst"), F.upper(F.regexp_replace("r.type", r"\s+", "_")).alias("etype"), F.lit(weight).alias("weight"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("outcome"), F.lit((1 << 62) - 1).alias("ord"), F.col("r.target").alias("label"))
    new = edge.select(F.col("dst").alias("id"), F.lit("entity").alias("type"), "label", "ord", F.lit(False).alias("is_record"))
    nodes = g.nodes.unionByName(new).groupBy("id").agg(F.min_by("type", "ord").alias("type"), F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"), F.bool_or("is_record").alias("is_record"))
    return Graph(nodes, upsert(g.edges.unionByName(edge.drop("label"))), g.config)


def quick_build(df: DataFrame, id_column: str | None = None, order_column: str | None = None, **options: Any) -> Graph:
    """Profiles, then builds with what the profile says."""
    from graphloom.operators import profile

    d = profile.profile(df, id_column)
    key = id_column or d.by_role("id")[0]
    c = Config(key, order_column or key, categorical=d.by_role("categorical"), lists=dict.fromkeys(d.by_role("list"), ""), numeric=[x for x in d.by_role("numeric") if x != order_column], **options)
    return build(df, c)


def resolve(nodes: DataFrame, name: str) -> DataFrame:
    """The node meant by a name: by id, else by label; the first by order."""
    text = F.lower(F.lit(name))
    tier = F.when((F.col("id") == text) | (F.col("id") == F.concat(F.lit("entity:"), text)), 1).when(F.lower("label") == text, 2)
    return nodes.withColumn("tier", tier).filter("tier is not null").orderBy("tier", "ord", "id").limit(1).drop("tier")


def auto_aliases(df: DataFrame, column: str, least: int = 2) -> DataFrame:
    """Spellings that agree without case, punctuation and company suffixes, mapped to the most frequent one."""
    item = F.explode(tx.items(F.col(column)))
    counts = df.select(item.alias("alias")).groupBy("alias").count()
    key = F.regexp_replace(F.regexp_replace(F.lower("alias"), r"[^a-z0-9 ]", ""), r"\s+(inc|llc|ltd|corp|co|gmbh)$", "")
    keyed = counts.withColumn("key", F.trim(key))
    best = keyed.groupBy("key").agg(F.max_by("alias", F.struct("count", "alias")).alias("canonical"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return keyed.join(best, "key").select("alias", "canonical")
