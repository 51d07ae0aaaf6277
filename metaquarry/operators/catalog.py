"""The Parquet catalogue: set-at-a-time reads, writes, classification and resolution of edges.

Each table is a list of folders that a manifest names. A change writes new folders beside the old
ones and then a manifest with the next number, which fails if there is one by then: readers never
see half of a change, several tables change together, and of two writers none loses what it wrote.
An append adds a folder, a rewrite replaces the list."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.schemas import TABLES, complete_identity, natural_id, struct_type
from metaquarry.session import cut


class ChangedMeanwhile(Exception):
    """Another writer has changed a table that is being rewritten."""


class Naming:
    """Names of tables: schema, prefix and name."""

    def __init__(self, schema: str = "", table_prefix: str = "META_"):
        self.schema, self.table_prefix = schema, table_prefix

    def table(self, name: str) -> str:
        full = self.table_prefix + name
        return f"{self.schema}.{full}" if self.schema else full

    def folder(self, name: str) -> str:
        return self.table(name).lower().replace(".", "/")


class Catalog:
    """Tables under one folder of a shared storage."""

    def __init__(self, spark: SparkSession, root: str, naming: Naming | None = None):
        self.spark, self.root, self.naming = spark, root.rstrip("/"), naming or Naming()

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.root)
        return hadoop, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, dict[str, list[str]]]:
        """The number of the last manifest, 0 for none, and the folders that hold the rows of each
        table."""
        hadoop, fs = self._fs()
        folder = hadoop.Path(f"{self.root}/_manifests")
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdecimal()] if fs.exists(folder) else []
        if not numbers:
            return 0, {}
        stream = fs.open(hadoop.Path(folder, f"{max(numbers):09d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), {name: paths for name, *paths in (line.split("\t") for line in text.splitlines() if line)}

    def _manifest(self) -> dict[str, list[str]]:
        return self._latest()[1]

    def _put(self, number: int, manifest: dict[str, list[str]]) -> bool:
        """Writes the manifest under its number in a single step; false if there is one already."""
        hadoop, fs = self._fs()
        new, at = hadoop.Path(f"{self.root}/_manifests/new-{uuid.uuid4().hex}"), hadoop.Path(f"{self.root}/_manifests/{number:09d}")
        stream = fs.create(new, True)
        stream.write(bytearray("".join("\t".join([k, *v]) + "\n" for k, v in sorted(manifest.items())), "utf-8"))
        stream.close()
        how = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(fs.getUri()).rename(fs.makeQualified(new), fs.makeQualified(at), how)
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def _commit(self, change: Callable[[dict[str, list[str]]], dict[str, list[str]]]) -> None:
        """Puts change(the last manifest) next; begins again if another writer was faster."""
        while True:
            number, now = self._latest()
            if self._put(number + 1, change(now)):
                return

    def _rewritten(self, make: Callable[[], dict[str, DataFrame]]) -> None:
        """Replaces tables by what make() gives from their rows; made anew if another writer has
        changed one of them meanwhile."""
        while True:
            base = self._manifest()
            written = {name: [self._write(name, df)] for name, df in make().items()}

            def change(now: dict[str, list[str]]) -> dict[str, list[str]]:
                if any(now.get(n) != base.get(n) for n in written):  # noqa: B023
                    raise ChangedMeanwhile
                return now | written  # noqa: B023

            try:
                return self._commit(change)
            except ChangedMeanwhile:
                continue

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.root}/{self.naming.folder(name)}/v-{uuid.uuid4().hex}"
        fields = struct_type(TABLES[name]).fields
        df.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.parquet(path)
        return path

    def migrate(self) -> None:
        """Creates every table that is missing, empty, with its declared schema."""
        have = self._manifest()
        self.replace({n: self.spark.createDataFrame([], struct_type(s)) for n, s in TABLES.items() if n not in have})

    def exists(self, name: str) -> bool:
        return name in self._manifest()

    def read(self, name: str) -> DataFrame:
        """The current rows of a table; a table that is not there is empty."""
        where = self._manifest().get(name)
        schema = struct_type(TABLES[name])
        return self.spark.read.schema(schema).parquet(*where) if where else self.spark.createDataFrame([], schema)

    def replace(self, tables: dict[str, DataFrame]) -> None:
        """Writes new versions of the tables and makes all of them current at once."""
        self._rewritten(lambda: tables)

    def append(self, tables: dict[str, DataFrame]) -> None:
        """Adds rows to the tables, all at once; what is stored is not rewritten."""
        written = {name: self._write(name, df) for name, df in tables.items()}
        self._commit(lambda now: now | {name: [*now.get(name, []), path] for name, path in written.items()})

    def compact(self, *names: str) -> None:
        """Brings the folders that appends have left behind into one each."""
        self._rewritten(lambda: {n: self.read(n) for n in names or tuple(self._manifest())})

    def create_objects(self, objects: DataFrame, columns: DataFrame, properties: DataFrame) -> DataFrame:
        """Stores new objects with their children in one change; gives back what is stored."""
        self.append({"OBJECT": objects, "COLUMN": columns, "PROPERTY": properties})
        return with_children(self.read("OBJECT").join(objects.select("object_id"), "object_id", "left_semi"), self.read("COLUMN"), self.read("PROPERTY"))

    def update_objects(self, changed: DataFrame, columns: DataFrame, properties: DataFrame) -> None:
        self._rewritten(lambda: {"OBJECT": updated(self.read("OBJECT"), changed), "COLUMN": with_replaced(self.read("COLUMN"), columns), "PROPERTY": with_replaced(self.read("PROPERTY"), properties)})

    def delete_objects(self, ids: DataFrame) -> DataFrame:
        """Deletes objects by id and gives them back; their children and edges stay."""
        ids = cut(ids.select("object_id").distinct())
        gone = []

        def rest() -> dict[str, DataFrame]:
            stored = self.read("OBJECT")
            gone[:] = [cut(stored.join(ids, "object_id", "left_semi"))]
            return {"OBJECT": stored.join(ids, "object_id", "left_anti")}

        self._rewritten(rest)
        return gone[0]

    def save_column_relations(self, relations: DataFrame) -> None:
        """Stores relations between columns (source_column_id, target_column_id, transformation)
        under ids made of these; what is stored already stays as it is."""
        new = relations.withColumn("relation_id", natural_id("source_column_id", "target_column_id", F.coalesce("transformation", F.lit("")))).dropDuplicates(["relation_id"])
        self.append({"COLUMN_RELATION": new.join(self.read("COLUMN_RELATION").select("relation_id"), "relation_id", "left_anti")})

    def find_column_relations(self, columns: DataFrame, end: str = "source") -> DataFrame:
        """The stored relations whose source or target is one of the columns (column_id)."""
        ids = columns.select(F.col("column_id").alias(f"{end}_column_id")).distinct()
        return self.read("COLUMN_RELATION").join(ids, f"{end}_column_id", "left_semi")

    def save_scan(self, jobs: DataFrame, targets: DataFrame, results: DataFrame) -> None:
        """Stores jobs with their targets and results in one change; later rows of a job, target or
        result take the place of earlier ones."""
        new = {"SCAN_JOB": ("scan_job_id", jobs), "SCAN_TARGET": ("target_id", targets), "SCAN_RESULT": ("result_id", results)}
        self._rewritten(lambda: {n: self.read(n).join(df.select(k), k, "left_anti").unionByName(df.select(*[f.name for f in struct_type(TABLES[n]).fields])) for n, (k, df) in new.items()})

    def create_relations(self, found: DataFrame, sources: DataFrame, created_at: Column | None = None) -> int:
        """Resolves and stores candidates; gives the number resolved, duplicates included."""
        edges = cut(resolve_candidates(found, sources, self.read("OBJECT")))
        new = new_edges(edges, self.read("RELATION")).withColumns({"relation_id": natural_id("from_object_id", "to_object_id", "relation_type", "source_type"), "created_at": created_at if created_at is not None else F.current_timestamp()})
        self.append({"RELATION": new})
        return edges.count()


def results_of(jobs: DataFrame, columns: DataFrame, relations: DataFrame, failures: DataFrame) -> DataFrame:
    """(scan_job_id, object_count, column_count, relation_count, error_count) of each job: how many
    different objects, columns, relations and failures it delivered, 0 where none. Each table is
    (scan_job_id, an id, ...) and is counted by itself before the join; jobs that are null or not in
    `jobs` do not count."""
    out = jobs.select("scan_job_id").where("scan_job_id is not null").distinct()
    parts = [columns.groupBy("scan_job_id").agg(F.count_distinct("object_id").alias("object_count"), F.count_distinct("column_id").alias("column_count"))]
    parts += [df.groupBy("scan_job_id").agg(F.count_distinct(i).alias(n)) for df, i, n in ((relations, "relation_id", "relation_count"), (failures, "failure_id", "error_count"))]
    for p in parts:
        out = out.join(p, "scan_job_id", "left")
    return out.na.fill(0)


def with_children(objects: DataFrame, columns: DataFrame, properties: DataFrame) -> DataFrame:
    """Objects with columns, in order of position, and properties, in order of name, as arrays.
    Children are combined per object before the join; an object without any has empty arrays."""
    c = columns.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name", "datatype", "nullable", "default_value", "is_primary_key", "is_unique"))).alias("columns"))
    p = properties.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("property_name", "property_value"))).alias("properties"))
    both = objects.join(c, "object_id", "left").join(p, "object_id", "left")
    return both.withColumns({"columns": F.coalesce("columns", F.array().cast(c.schema["columns"].dataType)), "properties": F.coalesce("properties", F.array().cast(p.schema["properties"].dataType))})


def lookup(objects: DataFrame, **fields: str) -> DataFrame:
    """Point lookup by any fields; the predicates reach the Parquet scan."""
    for k, v in fields.items():
        objects = objects.where(F.col(k) == F.lit(v))
    return objects


def first_by_qualified_name(objects: DataFrame) -> DataFrame:
    """One object of each qualified name: the first by system and id. Combined before the shuffle."""
    return objects.groupBy("qualified_name").agg(F.min(F.struct("system_name", "object_id")).alias("m")).select("qualified_name", F.col("m.system_name").alias("system_name"), F.col("m.object_id").alias("object_id"))


def existing(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """The objects that are stored under their id or their natural key, as two semi joins."""
    by_id = objects.join(stored.select("object_id").distinct(), "object_id", "left_semi")
    by_key = objects.join(stored.select("system_name", "qualified_name").distinct(), ["system_name", "qualified_name"], "left_semi")
    return by_id.unionByName(by_key.select(*by_id.columns)).dropDuplicates()


def classify(objects: DataFrame, stored: DataFrame, order: str = "seq") -> DataFrame:
    """Adds outcome: failed without complete names; skipped if stored under its id or natural key,
    or if an earlier row of the batch has the same id or key; else created."""
    fine = complete_identity()
    ids = stored.select("object_id").distinct().withColumn("_id", F.lit(True))
    keys = stored.select("system_name", "qualified_name").distinct().withColumn("_key", F.lit(True))
    # First rows by grouping, which combines before the shuffle; a window would sort a hot key in one task.
    firsts = lambda name, *c: objects.where(fine).groupBy(*c).agg(F.min(order).alias(name))
    o = objects.join(ids, "object_id", "left").join(keys, ["system_name", "qualified_name"], "left")
    o = o.join(firsts("_f1", "system_name", "qualified_name"), ["system_name", "qualified_name"], "left").join(firsts("_f2", "object_id"), "object_id", "left")
    late = (F.col(order) > F.col("_f1")) | (F.col(order) > F.col("_f2"))
    outcome = F.when(~fine, "failed").when(F.col("_id").isNotNull() | F.col("_key").isNotNull() | late, "skipped").otherwise("created")
    return o.withColumn("outcome", outcome).select(*objects.columns, "outcome")


def outcome_counts(classified: DataFrame) -> DataFrame:
    return classified.agg(*[F.count_if(F.col("outcome") == k).alias(f"objects_{k}") for k in ("created", "skipped", "failed")])


def resolve_candidates(found: DataFrame, sources: DataFrame, objects: DataFrame) -> DataFrame:
    """(from_object_id, to_object_id, relation_type, source_type) of the candidates whose target is
    an object: of the source's system, else the first of that qualified name. Case matters.
    found has object_id of the source; sources its system_name. Others are dropped."""
    of = found.join(sources.select("object_id", "system_name"), "object_id")
    own = objects.groupBy("system_name", "qualified_name").agg(F.min("object_id").alias("own_id")).withColumnRenamed("qualified_name", "target_qualified_name")
    any_ = first_by_qualified_name(objects).select(F.col("qualified_name").alias("target_qualified_name"), F.col("object_id").alias("any_id"))
    r = of.join(own, ["system_name", "target_qualified_name"], "left").join(any_, "target_qualified_name", "left")
    return r.select(F.col("object_id").alias("from_object_id"), F.coalesce("own_id", "any_id").alias("to_object_id"), "relation_type", "source_type").where("to_object_id is not null")


def new_edges(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges that are not stored, each once: an edge is its ends, type and source type."""
    key = ["from_object_id", "to_object_id", "relation_type", "source_type"]
    return edges.select(*key).dropDuplicates().join(stored.select(*key), key, "left_anti")


def upstream(relations: DataFrame, object_id: str) -> DataFrame:
    """Edges into an object in order of time and id."""
    return relations.where(F.col("to_object_id") == object_id).orderBy("created_at", "relation_id")


def downstream(relations: DataFrame, object_id: str) -> DataFrame:
    return relations.where(F.col("from_object_id") == object_id).orderBy("created_at", "relation_id")


def updated(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored objects with all fields of their changed row; changed rows of unknown ids are ignored."""
    fields = [c for c in stored.columns if c != "object_id"]
    new = changed.select("object_id", F.struct(*fields).alias("_n")).dropDuplicates(["object_id"])
    j = stored.join(new, "object_id", "left")
    return j.select("object_id", *[F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) for c in fields])


def with_replaced(stored: DataFrame, children: DataFrame) -> DataFrame:
    """Children of the objects that bring new ones are replaced, those of others stay."""
    return stored.join(children.select("object_id").distinct(), "object_id", "left_anti").unionByName(children.select(*stored.columns))


def current_versions(versions: DataFrame) -> DataFrame:
    """The version with the highest number of each object, then the latest; combined before the shuffle."""
    v = versions.groupBy("object_id").agg(F.max_by(F.struct("version_id", "version_number", "hash_value"), F.struct("version_number", "created_at", "version_id")).alias("v"))
    return v.select("object_id", "v.*")


def changed_targets(targets: DataFrame, last: DataFrame) -> DataFrame:
    """Scan targets with changed: whether the hash differs from the last one of the same path."""
    before = last.groupBy("target_path").agg(F.max_by("hash_value", F.struct("scanned_at", "hash_value")).alias("_h"))
    return targets.join(before, "target_path", "left").withColumn("changed", ~F.col("hash_value").eqNullSafe(F.col("_h"))).drop("_h")


def tags_of(object_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(object_id, tag_id, name) of each tag that is attached to an object, once."""
    return object_tags.select("object_id", "tag_id").dropDuplicates().join(tags.select("tag_id", "name"), "tag_id").select("object_id", "tag_id", "name")


def pii_hits(columns: DataFrame, rules: list[tuple[str, str, str, int]], *, name: str = "column_name") -> DataFrame:
    """(column_id, rule_id, category) of the enabled rule of highest priority, then smallest id,
    that matches a column's name. rules: rule_id, category, pattern, priority; a list made by
    hand, so each becomes a predicate of one pass over the columns."""
    hit = F.lit(None).cast("struct<rule_id:string,category:string>")
    for rule, category, pattern, _ in sorted(rules, key=lambda r: (r[3], [-ord(c) for c in r[0]])):
        hit = F.when(F.col(name).rlike(pattern), F.struct(F.lit(rule).alias("rule_id"), F.lit(category).alias("category"))).otherwise(hit)
    return columns.select("column_id", hit.alias("h")).where("h is not null").select("column_id", "h.rule_id", "h.category")
