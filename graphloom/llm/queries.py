"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import cooccur, credentials, docpairs, encode, handwritten, mix, parses, quality, split, vectorgraph
from graphloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return parses.found(table(spark, d, "files"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return parses.rates(table(spark, d, "files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.found(table(spark, d, "files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return vectorgraph.found(table(spark, d, "symbol_vectors"))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectorgraph.neighbours(table(spark, d, "symbol_vectors")).drop("dim")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.found(table(spark, d, "symbols"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "symbols"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find(table(spark, d, "files"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redact(table(spark, d, "files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split.found(table(spark, d, "symbols"), table(spark, d, "files"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.pieces(table(spark, d, "symbols"), table(spark, d, "files"))


def p6_contents(spark: SparkSession, d: str) -> DataFrame:
    return split.emit(table(spark, d, "symbols"), table(spark, d, "files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.found(table(spark, d, "commit_files"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mix.report(*mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.found(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


P7_SQL = r"""
with r as (
  select distinct repo_id, commit_sha, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') as path
  from commit_files where file_path is not null and repo_id is not null and commit_sha is not null),
k as (select repo_id, commit_sha, count(*) as size from r group by 1, 2),
repo as (select repo_id, count(*) as n from k group by 1),
item as (select repo_id, path, count(*) as n from r group by 1, 2),
counted as (select r.* from r join k using (repo_id, commit_sha) where k.size between 2 and 30),
pair as (
  select a.repo_id, a.path as file_a, b.path as file_b, count(*) as support
  from counted a join counted b on a.repo_id = b.repo_id and a.commit_sha = b.commit_sha and a.path < b.path
  group by 1, 2, 3 having count(*) >= 5)
select p.repo_id, file_a, file_b
from pair p join item a on a.repo_id = p.repo_id and a.path = file_a
join item b on b.repo_id = p.repo_id and b.path = file_b join repo on repo.repo_id = p.repo_id
where support * repo.n >= 3 * a.n * b.n
"""


P6_SQL = """
select distinct s.id from symbols s join files f on f.repo_id = s.repo_id and f.path = s.file_path
where s.start_byte >= 0 and s.start_byte < s.end_byte and s.end_byte <= octet_length(f.raw_content) and s.end_byte - s.start_byte > 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_SQL, "p7_found": P7_SQL}
