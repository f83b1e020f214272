"""The queries of the general problems p1 to p4, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import drift, hierarchy, nesting, references
from tessera.operators.references import Reference, Target, composed, normal_hash
from tessera.queries import drift_sql, nesting_sql
from tessera.session import cut_lineage, table

VALID_BY = ("generation", "ingested_at")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference to a record that is missing, late or deleted."""
    t = lambda name: table(spark, sf_dir, name)
    targets = [
        Target("payload_blobs", t("payload_blobs"), normal_hash("payload_hash_full")),
        Target("binary_blobs", t("binary_blobs"), normal_hash("binary_hash")),
        Target("artifacts", t("artifacts"), F.col("artifact_id"), removed_at="deleted_at", valid_by=VALID_BY),
        Target("artifact_schema_roots", t("artifact_schema_roots"), composed("artifact_id", "root_key")),
    ]
    refs = [
        Reference("artifacts", t("artifacts").where("artifact_id is not null"), ("artifact_id",), normal_hash("payload_hash_full"), "payload_blobs", key_fixes_target=False),
        Reference("payload_binary_refs", t("payload_binary_refs"), ("payload_hash_full", "binary_hash"), normal_hash("binary_hash"), "binary_blobs"),
        Reference("artifact_records", t("artifact_records"), ("artifact_id", "root_path", "idx"), F.col("artifact_id"), "artifacts", check_removed=True),
        Reference("artifact_schema_fields", t("artifact_schema_fields"), ("artifact_id", "root_key", "field_path"), composed("artifact_id", "root_key"), "artifact_schema_roots"),
    ]
    return references.dangling_references(refs, targets)


def p1_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of those references per table, reason and month."""
    return references.dangling_by_period(p1_found(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every schema change with the capture where it first shows."""
    return drift.schema_changes(*(table(spark, sf_dir, n) for n in ("artifacts", "artifact_schema_roots", "artifact_schema_fields")))


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs the matching picked: renames for certain, and ambiguous ones that are likely the same column."""
    found = drift.differences(*(table(spark, sf_dir, n) for n in ("artifacts", "artifact_schema_roots", "artifact_schema_fields")))
    return found.where(F.col("change").isin("renamed", "likely"))


def _unifying(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unified names, mixed columns and all unified columns."""
    tables = artifacts, _, fields = [table(spark, sf_dir, n) for n in ("artifacts", "artifact_schema_roots", "artifact_schema_fields")]
    names = cut_lineage(drift.column_names(*tables))
    return names, drift.mixed_columns(artifacts, fields, names), drift.unified_columns(artifacts, fields, names)


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as one table whose columns go by one name, at every depth, and have one type through all changes."""
    names, mixed, _ = _unifying(spark, sf_dir)
    return drift.unified_records(table(spark, sf_dir, "artifact_records"), names, mixed=mixed)


def p2_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of every series' unified table with their types."""
    return _unifying(spark, sf_dir)[2]


def p2_table_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of one tool's records through all renames and retypings."""
    return drift.typed_table(table(spark, sf_dir, "artifact_records"), table(spark, sf_dir, "artifacts"), *_unifying(spark, sf_dir), "crew.people", "$")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object in an array inside a record, with the link to the object around it."""
    return nesting.nested_objects(table(spark, sf_dir, "artifact_records")).select("artifact_id", "root_path", "idx", "node_path", "parent_path")


def _record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nesting.flat_rows(table(spark, sf_dir, "artifact_records"))


def p3_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of subtype tables: supertype, variant, fields, rows."""
    return nesting.subtype_catalog(_record_rows(spark, sf_dir))


def p3_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of every supertype's table with the type that holds all their values."""
    return nesting.column_types(_record_rows(spark, sf_dir), by=("place",))


def p3_variant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of every subtype table with their types."""
    return nesting.column_types(_record_rows(spark, sf_dir))


def p3_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the subtype tables: every record, object in an array and other element with place, variant, fields and parent link."""
    return _record_rows(spark, sf_dir).select("place", "variant", "artifact_id", "root_path", "idx", "node_path", "parent_path", "fields")


def p3_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every record at its row and field; numbers as numbers, whatever else as text."""
    cells = nesting.cells(_record_rows(spark, sf_dir))
    number = F.col("kind").isin("integer", "number")
    kind = F.when(number, "number").otherwise(F.col("kind"))
    return cells.select("artifact_id", "root_path", "idx", "node_path", "parent_path", "place", "field", kind.alias("kind"), F.when(~number, F.col("value")).alias("text"), F.when(number, F.expr("try_cast(value as double)")).alias("number"))


def _typed(rows: DataFrame, place: str, fields: dict[str, str] | None = None) -> DataFrame:
    found = nesting.subtype_table(rows, place, fields).drop("variant")
    return found.toDF(*[c.replace(".", "_") for c in found.columns])


def p3_table_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of one supertype: releases of repositories, linked to their record."""
    return _typed(_record_rows(spark, sf_dir), "$.releases[*]", {"tag": "string", "assets": "string"})


def p3_table_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of the assets of releases, linked to their release."""
    return _typed(_record_rows(spark, sf_dir), "$.releases[*].assets[*]")


def p3_table_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of the elements of an array of numbers."""
    return _typed(_record_rows(spark, sf_dir), "$.geometry.coordinates[*]")


def p3_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the subtype tables of envelopes."""
    found = nesting.flat_rows(table(spark, sf_dir, "payload_blobs"), ("payload_hash_full",), "envelope")
    return found.select("place", "variant", "payload_hash_full", "node_path", "parent_path", "fields")


def p3_envelope_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each kind every field of the envelopes' tables has."""
    found = nesting.cells(nesting.flat_rows(table(spark, sf_dir, "payload_blobs"), ("payload_hash_full",), "envelope"))
    kind = F.when(F.col("kind") == "integer", "number").otherwise(F.col("kind"))
    return found.groupBy("place", "field", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def p3_field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field path of a profile as a field of the object it belongs to, which is the root or an array's element."""
    return nesting.nested_paths(table(spark, sf_dir, "artifact_schema_fields"), ("artifact_id", "root_key"), "field_path")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth, number of descendants and state of every artifact."""
    found = hierarchy.hierarchy(table(spark, sf_dir, "artifacts"), "artifact_id", "parent_artifact_id", VALID_BY)
    return found.select(F.col("id").alias("artifact_id"), "root_id", "depth", "n_desc", "state")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every artifact's path from its root, or from the first member of a cycle, down to it."""
    return hierarchy.paths(table(spark, sf_dir, "artifacts"), "artifact_id", "parent_artifact_id", VALID_BY).withColumnRenamed("id", "artifact_id")


def p4_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every artifact with each artifact it reaches by going up; read the other way round, its descendants."""
    pairs = hierarchy.ancestor_pairs(table(spark, sf_dir, "artifacts"), "artifact_id", "parent_artifact_id", VALID_BY)
    return pairs.select(F.col("id").alias("artifact_id"), "ancestor_id", "distance")


QUERIES = {f.__name__: f for f in (p1_found, p1_by_period, p2_found, p2_matches, p2_unified, p2_columns, p2_table_people, p3_found, p3_subtypes, p3_columns, p3_variant_columns, p3_objects, p3_cells, p3_table_releases, p3_table_assets, p3_table_coordinates, p3_envelopes, p3_envelope_cells, p3_field_paths, p4_found, p4_paths, p4_ancestors)}

_P1 = """
with h as (select artifact_id, regexp_replace(lower(trim(payload_hash_full, e' \\t\\r\\n')), '^sha256:', '') k, ingested_at from artifacts where artifact_id is not null and payload_hash_full is not null),
pb as (select regexp_replace(lower(trim(payload_hash_full, e' \\t\\r\\n')), '^sha256:', '') k, min(ingested_at) since from payload_blobs group by 1),
bb as (select regexp_replace(lower(trim(binary_hash, e' \\t\\r\\n')), '^sha256:', '') k, min(ingested_at) since from binary_blobs group by 1),
ar as (select artifact_id k, min(ingested_at) since, arg_max(coalesce(deleted_at, timestamp '9999-01-01'), (generation, ingested_at)) del from artifacts group by 1),
rt as (select artifact_id a, root_key r, min(ingested_at) since from artifact_schema_roots group by 1, 2),
refs as (
  select 'artifacts' ref_table, artifact_id row_key, seen, pb.k is null missing, since, null::timestamp del
  from (select artifact_id, min(ingested_at) seen, arg_min(k, ingested_at) k from h group by 1) c left join pb on c.k = pb.k
  union all
  select 'payload_binary_refs', concat_ws('|', coalesce(payload_hash_full, ''), binary_hash), seen, bb.k is null, since, null
  from (select payload_hash_full, binary_hash, min(ingested_at) seen from payload_binary_refs where binary_hash is not null group by 1, 2) c
  left join bb on regexp_replace(lower(trim(c.binary_hash, e' \\t\\r\\n')), '^sha256:', '') = bb.k
  union all
  select 'artifact_records', concat_ws('|', artifact_id, coalesce(root_path, ''), coalesce(idx::varchar, '')), seen, ar.k is null, since, del
  from (select artifact_id, root_path, idx, min(ingested_at) seen from artifact_records where artifact_id is not null group by 1, 2, 3) c left join ar on c.artifact_id = ar.k
  union all
  select 'artifact_schema_fields', concat_ws('|', artifact_id, root_key, coalesce(field_path, '')), seen, rt.a is null, since, null
  from (select artifact_id, root_key, field_path, min(ingested_at) seen from artifact_schema_fields where artifact_id is not null and root_key is not null group by 1, 2, 3) c
  left join rt on c.artifact_id = rt.a and c.root_key = rt.r),
found as (select ref_table, row_key, case when missing then 'missing' when since > seen then 'late' when del <= seen then 'deleted' end reason, strftime(seen, '%Y-%m') period from refs)
"""

_P4 = """
with recursive v as (select artifact_id id, lower(trim(artifact_id)) k, nullif(lower(trim(coalesce(parent_artifact_id, ''))), '') p
  from (select *, row_number() over (partition by artifact_id order by generation desc, ingested_at desc) n from artifacts) where n = 1),
up(k, a, d) as (select v.k, v.p, 1 from v where exists (select 1 from v w where w.k = v.p)
  union select up.k, v.p, d + 1 from up join v on v.k = up.a where exists (select 1 from v w where w.k = v.p) and d < 400),
pairs as (select k, a, min(d) d from up group by 1, 2), cyc as (select k from pairs where k = a),
ends as (select v.k, v.id, v.p, (select count(*) from pairs where pairs.a = v.k and pairs.k <> v.k) n_desc, v.k in (select k from cyc) c from v),
far as (select k, max(d) d from pairs group by 1),
first as (select pairs.k, min(d) d from pairs join cyc on cyc.k = pairs.a group by 1),
found as (select e.id artifact_id,
  case when e.c then (select min(y.id) from pairs q join v y on y.k = q.a where q.k = e.k)
       when f.k is not null then (select min(z.id) from pairs q join cyc on cyc.k = q.a join v z on z.k = q.a where q.k = e.k)
       when far.k is null then e.id else (select y.id from pairs q join v y on y.k = q.a where q.k = e.k and q.d = far.d) end root_id,
  (case when e.c then 0 when f.k is not null then f.d else coalesce(far.d, 0) end)::bigint depth, e.n_desc::bigint n_desc,
  case when e.c then 'cycle' when f.k is not null then 'below_cycle'
       when (select y.p from v y where y.k = coalesce((select q.a from pairs q where q.k = e.k and q.d = far.d), e.k)) is null then 'tree' else 'dangling' end state
from ends e left join far on far.k = e.k left join first f on f.k = e.k)
"""

ORACLE = drift_sql.ORACLE | nesting_sql.ORACLE | {
    "p1_found": _P1 + "select * from found where reason is not null",
    "p1_by_period": _P1 + "select ref_table, reason, period, count(*)::bigint n from found where reason is not null group by 1, 2, 3",
    "p4_ancestors": _P4 + "select x.id artifact_id, y.id ancestor_id, d::bigint distance from pairs join v x using (k) join v y on y.k = pairs.a",
    "p4_found": _P4 + "select * from found",
    "p4_paths": _P4
    + """select f.*, list_append(coalesce(o.path, []), f.artifact_id) path from found f left join
(select x.id, list(y.id order by d desc) path from found g join v x on x.id = g.artifact_id join pairs on pairs.k = x.k join v y on y.k = pairs.a where d <= g.depth group by 1) o on o.id = f.artifact_id""",
}
