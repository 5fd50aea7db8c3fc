"""Sources and sinks: corpora, gazetteers, code tables and ledgers, with the formats Spark reads itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TASK = "id string, corpus string, text string, gold_ref string, gold_refs array<string>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, malformed ones kept as null rows."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def interleave(parts: list[DataFrame], order: str) -> DataFrame:
    """Round robin over the tables: first rows of each, then the second ones, ... as column `position`.

    A row's place within its table is the count of smaller rows, found in buckets of the order's quantiles; its position
    follows from it and the sizes of the other tables, so no table passes through one task.
    """
    sizes = [part.count() for part in parts]
    out = None
    for i, part in enumerate(parts):
        ranked = _places(part, order, sizes[i]).withColumnRenamed("position", "_row")
        ahead = F.lit(0).cast("long")
        for j, n in enumerate(sizes):
            if j != i:  # rows of other tables that stand before: all earlier rounds, and this one for tables before
                ahead = ahead + F.least(F.col("_row") + (1 if j < i else 0), F.lit(n))
        ranked = ranked.withColumn("position", F.col("_row") + ahead).drop("_row")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def _places(rows: DataFrame, order: str, n: int, least: int = 100_000) -> DataFrame:
    """rows with position in the order; large tables are ranked in buckets of the order column's hash-free prefix."""
    from redactum.operators import reports

    kind = dict(rows.dtypes)[order]
    if n <= least:
        bucket = F.lit(0)
    elif kind in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        bounds = rows.approxQuantile(order, [k / 256 for k in range(1, 256)], 0.001)
        bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order)))
    else:  # a file name and a row number of a scan
        bucket = F.struct(F.col(f"{order}.file_path"), F.shiftright(F.col(f"{order}.col2"), 33)) if kind.startswith("struct") else F.col(order)
    return reports.positions(rows, bucket, order)


def seeded_order(rows: DataFrame, head: Column, key: str, *, seed: str) -> DataFrame:
    """rows with position: the head keeps its order by key, the tail follows in the order of sha2(seed|key). Ranked in
    buckets of the hash's first digits."""
    from redactum.operators import reports

    order = F.when(head, F.lpad(F.col(key).cast("string"), 9, "0")).otherwise(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256))
    rows = rows.withColumn("_o", order)
    bucket = F.when(head, F.lit("")).otherwise(F.concat(F.lit("~"), F.substring("_o", 1, 3)))
    return reports.positions(rows, bucket, "_o", key).drop("_o")


def load_tasks(spark: SparkSession, paths: list[str], n: int | None = None) -> DataFrame:
    """Task documents of one or several files, interleaved by line, the first n."""
    rows = interleave([read_jsonl(spark, p, TASK).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())) for p in paths], "_at").drop("_at")
    return rows if n is None else rows.where(F.col("position") < n)


def references(gold_refs: Column, gold_ref: Column) -> Column:
    """The list of references, else the single one; an empty list counts as none."""
    return F.when(F.size(gold_refs) > 0, gold_refs).otherwise(F.array(gold_ref))


def to_item(rows: DataFrame, corpus: str) -> DataFrame:
    """Benchmark items: id, else doc_id, else the padded position names the row."""
    name = F.coalesce(F.nullif("id", F.lit("")), F.nullif("doc_id", F.lit("")), F.lpad(F.col("position").cast("string"), 6, "0"))
    return rows.select(F.concat(F.lit(corpus + "/"), name).alias("item_id"), F.lit(corpus).alias("corpus"), F.col("text").alias("doc_orig"))


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = False) -> DataFrame:
    """Delimited text (gazetteers, occupation tables, provider files)."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def gazetteer(places: DataFrame) -> DataFrame:
    """places (name, ascii_name, country, region, population). One row per lower-case name, the most populous place."""
    both = places.select(F.lower("name").alias("surface"), "country", "region", "population").unionByName(places.select(F.lower("ascii_name").alias("surface"), "country", "region", "population"))
    return both.where("surface IS NOT NULL").groupBy("surface").agg(F.max(F.struct("population", "country", "region")).alias("x")).select("surface", "x.country", "x.region", "x.population")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """A profile artifact {profiles: {type: {canonical: row}}} as rows (type, canonical, aliases, levels, count)."""
    row = "struct<aliases:array<string>,levels:array<string>,count:double>"
    doc = spark.read.schema(f"profiles map<string,map<string,{row}>>").option("multiLine", True).json(path)
    return profile_rows(doc)


def stanza_fields(text: DataFrame) -> DataFrame:
    """Terms of an ontology in stanza form (value: one stanza): id, name, synonyms, parents."""
    every = lambda p: F.regexp_extract_all("value", F.lit(p))
    return text.select(F.regexp_extract("value", r"(?m)^id: (\S+)", 1).alias("id"), F.regexp_extract("value", r"(?m)^name: (.+)$", 1).alias("name"), every(r'(?m)^synonym: "([^"]*)"').alias("synonyms"), every(r"(?m)^is_a: (\S+)").alias("parents"))


def stanzas(spark: SparkSession, path: str) -> DataFrame:
    """Ontology terms of an OBO file; a stanza is a record."""
    return stanza_fields(spark.read.option("lineSep", "\n[").text(path).where(F.col("value").startswith("Term]")))


def order_lines(text: DataFrame) -> DataFrame:
    """Fixed-layout code lines (order, code, valid, descriptions): valid seven-character codes with the last description."""
    p = F.split("value", r"[ ]+", 4)
    rows = text.where(F.size(p) == 4).select(p[1].alias("code"), p[2].alias("valid"), F.trim(F.element_at(F.split(p[3], "  +"), -1)).alias("description"))
    return rows.where((F.col("valid") == "1") & F.col("code").rlike("^[A-Z0-9]{7}$")).drop("valid")


def reviewable(alias: Column) -> Column:
    """Aliases of up to 48 plain characters."""
    return (F.length(alias) <= 48) & alias.rlike(r"^[A-Za-z0-9 .,'()/&-]+$")


def typed_cache(rows: DataFrame) -> DataFrame:
    """Cache rows keyed type::surface; keys without a type are dropped."""
    k = F.split("key", "::", 2)
    return rows.where(F.size(k) == 2).select(k[0].alias("type"), k[1].alias("surface"), "value")


def alias_rows(kind: str, table: dict[str, list[str]], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(kind, c, a) for c, names in table.items() for a in names], "type string, canonical string, alias string")


def split_mail(body: Column, mark: str = "@subject") -> Column:
    """(text, subject) of a mail with a literal mark."""
    return F.struct(F.trim(F.substring_index(body, mark, 1)).alias("text"), F.trim(F.when(F.instr(body, mark) > 0, F.substring_index(body, mark, -1)).otherwise("")).alias("subject"))


def split_reply(body: Column) -> Column:
    """(reply, quoted) of a top-posted mail: cut before the first separator line or '>' line."""
    parts = F.split(body, r"(?m)^(?=>|-+ ?Original Message|On .* wrote:)", 2)
    return F.struct(F.regexp_replace(parts[0], r"^\s+|\s+$", "").alias("reply"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("quoted"))


def cache_identity(*columns: str) -> Column:
    """Content address: sha256 of the canonical JSON of the columns, names sorted."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def config_hash(*columns: str) -> Column:
    return F.substring(cache_identity(*columns), 1, 16)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, keys sorted."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def json_lines(df: DataFrame, key: str) -> DataFrame:
    """(key, line): each row as one line of canonical JSON, keys sorted, nulls kept."""
    return df.select(key, F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line"))


def from_json_lines(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """lines with the fields of their JSON beside them; a malformed line has null fields."""
    return lines.select(F.col(line), F.from_json(F.col(line), schema).alias("_r")).select(line, "_r.*")


def profile_rows(documents: DataFrame) -> DataFrame:
    """documents (profiles: map type -> map canonical -> row) as rows (type, canonical, aliases, levels, count)."""
    t = documents.select(F.explode("profiles").alias("type", "entries")).select("type", F.explode("entries").alias("canonical", "r"))
    return t.select("type", "canonical", "r.aliases", "r.levels", "r.count")


def product_rows(products: DataFrame, key: str, *, most_words: int = 4) -> DataFrame:
    """products (key, names array). (name, products, aliases): every lower-case name without digits and of at most
    `most_words` words, the other such names of its products, and how many products bear it."""
    one = products.select(key, F.explode("names").alias("n")).select(key, F.lower("n").alias("name")).where(~F.col("name").rlike("[0-9]") & (F.size(F.split("name", " ")) <= most_words)).distinct()
    other = one.select(key, F.col("name").alias("other"))
    aliases = one.join(other, key).where("name <> other").groupBy("name").agg(F.array_sort(F.collect_set("other")).alias("aliases"))
    return one.groupBy("name").agg(F.count("*").alias("products")).join(aliases, "name", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def term_levels(terms: DataFrame, roots: dict[str, str], depth: int = 6) -> DataFrame:
    """terms (id, name, parents). (id, name, levels): the names of the families (roots by id) above a term, nearest
    first, then by id; terms without a family are dropped."""
    from redactum.operators import lattice

    edges = terms.select(F.col("id").alias("child"), F.explode("parents").alias("parent"))
    family = F.create_map(*[F.lit(x) for kv in roots.items() for x in kv])
    up = lattice.ancestors(edges, depth).withColumn("family", family[F.col("ancestor")]).where("family IS NOT NULL")
    levels = up.groupBy(F.col("node").alias("id")).agg(F.array_sort(F.collect_set(F.struct("hops", "ancestor", "family"))).alias("x"))
    return terms.join(levels, "id").select("id", "name", F.array_distinct(F.transform("x", lambda i: i.family)).alias("levels"))


def territories(documents: DataFrame, value: str = "value") -> DataFrame:
    """(code, name) of a JSON object keyed by code; a malformed document has none."""
    return documents.select(F.explode(F.from_json(value, "map<string,string>")).alias("code", "name")).where("name IS NOT NULL")
