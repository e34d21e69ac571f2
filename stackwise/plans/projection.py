"""The catalogue projection: bibliographic records made from the table ``part``.

It puts known values at known places, so that each record operator has a relational answer.  ``SQL``
gives those values for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import FIELDS_DDL

#: A file of this size or less is read by one task.
ONE_TASK = 128 << 20
_COLUMNS = {
    "ctl": "concat('b', lpad(CAST(k AS string), 8, '0'))",
    "year": "CAST(1950 + p_size AS string)",
    "isbn": "concat(core, IF(k % 5 = 0, 'X', CAST((10 - s % 10) % 10 AS string)))",
    "ta": "concat(split_part(p_name, ' ', 1), ' :')",
    "tb": "concat(split_part(p_name, ' ', 2), ' /')",
    "tc": "concat('by ', p_brand, IF(k % 9 = 0, ' et al.', '.'))",
    "pa": "IF(k % 10 = 0, '[S.l.] :', 'Anytown :')",
    "pb": "concat(p_brand, ' Press,')",
    "url": "concat('https://Host', k % 10, '.example.org/item/', k)",
    "leader": "concat('00000n', IF(k % 11 = 0, 'j', 'a'), IF(k % 13 = 0, 's', 'm'), ' ', IF(k % 2 = 0, 'a', ' '), '2200000 ', IF(k % 4 = 0, 'i', 'a'), ' 4500')",
}


def _control(tag: str, value: str, when: str = "true") -> str:
    return f"IF({when}, named_struct('tag', '{tag}', 'ind1', CAST(NULL AS string), 'ind2', CAST(NULL AS string), 'value', {value}, 'subfields', CAST(NULL AS array<struct<code:string,value:string>>)), NULL)"


def _data(tag: str, inds: str, *parts: tuple[str, str], when: str = "true") -> str:
    own = ", ".join(f"named_struct('code', '{c}', 'value', {v})" if w is None else f"IF({w}, named_struct('code', '{c}', 'value', {v}), NULL)" for c, v, w in ((*p, None)[:3] for p in parts))
    return f"IF({when}, named_struct('tag', '{tag}', 'ind1', '{inds[0]}', 'ind2', '{inds[1]}', 'value', CAST(NULL AS string), 'subfields', array_compact(array({own}))), NULL)"


_FIELDS = [
    _control("001", "ctl"),
    _control("003", "'SWK'", "k % 3 != 0"),
    _control("008", "concat('240101s', year, '    xxu', repeat(' ', 17), 'eng d')"),
    _data("020", "  ", ("a", "isbn")),
    _data("040", "  ", ("a", "'SWK'"), ("e", "'rda'", "k % 4 = 0")),
    _data("050", " 4", ("a", "concat('QA', k % 900 + 1, '.', p_size)"), ("b", "concat('.B', p_size, ' ', year)")),
    _data("100", "1 ", ("a", "concat(p_brand, ',')"), ("e", "'author'", "k % 4 = 0"), ("0", "concat('http://id.loc.gov/authorities/names/n', k)", "k % 7 = 0")),
    _data("245", "10", ("a", "ta"), ("b", "tb"), ("c", "tc"), when="k % 17 != 0"),
    _data("250", "  ", ("a", "'2nd ed.'"), when="k % 6 = 0"),
    _data("260", "  ", ("a", "pa"), ("b", "pb"), ("c", "concat('c', year, '.')"), when="k % 2 = 0"),
    _data("264", " 1", ("a", "pa"), ("b", "pb"), ("c", "concat('c', year, '.')"), when="k % 2 != 0"),
    _data("300", "  ", ("a", "concat(p_size, ' p. :')"), ("b", "'ill. ;'"), ("c", "'23 cm'")),
    _data("650", " 0", ("a", "concat(p_type, '.')"), ("x", "'Catalogues'")),
    _data("650", " 0", ("a", "concat('Things, ', p_type)"), when="k % 3 = 0"),
    _data("700", "1 ", ("a", "concat('Helper, ', p_brand)"), when="k % 8 = 0"),
    _data("856", "40", ("u", "url"), ("y", "'Online'", "k % 3 = 1")),
]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is read from fewer files than there are and none is large enough
    to be read by several tasks; else untouched."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return df.repartition(cores) if 0 < files < cores and size <= files * ONE_TASK else df


def bib(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """Records in the nested shape, one for each part; ``in_order`` by their numbers, which sorts the
    narrow rows of the parts."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    if in_order:
        tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        part = part.repartitionByRange(tasks, "p_partkey").sortWithinPartitions("p_partkey")
    else:
        part = spread(part)
    part = part.withColumn("k", F.col("p_partkey"))
    part = part.withColumn("core", F.expr("concat('978', lpad(CAST(k AS string), 9, '0'))"))
    part = part.withColumn("s", F.expr("aggregate(sequence(1, 12), 0, (n, i) -> n + CAST(substring(core, i, 1) AS INT) * IF(i % 2 = 0, 3, 1))"))
    part = part.withColumns({name: F.expr(e) for name, e in _COLUMNS.items()})
    fields = F.expr(f"array_compact(array({', '.join(_FIELDS)}))").cast(FIELDS_DDL)
    return part.select(F.col("k").alias("record_no"), F.lit("part").alias("file"), F.col("ctl").alias("control_number"), "leader", fields.alias("fields"))


#: The projection's values for DuckDB, as the start of a query; columns k, ctl, year, isbn, …
SQL = """WITH p AS (SELECT *, p_partkey AS k, '978' || lpad(p_partkey::VARCHAR, 9, '0') AS core FROM part),
c AS (SELECT *, list_sum(list_transform(range(1, 13), lambda i: core[i]::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) AS s FROM p),
b AS (SELECT *, 'b' || lpad(k::VARCHAR, 8, '0') AS ctl, (1950 + p_size)::VARCHAR AS year,
 core || CASE WHEN k % 5 = 0 THEN 'X' ELSE ((10 - s % 10) % 10)::BIGINT::VARCHAR END AS isbn, k % 5 <> 0 AS isbn_ok,
 CASE WHEN k % 17 <> 0 THEN split_part(p_name, ' ', 1) END AS t1, CASE WHEN k % 17 <> 0 THEN split_part(p_name, ' ', 2) END AS t2,
 CASE WHEN k % 17 <> 0 THEN 'by ' || p_brand || CASE WHEN k % 9 = 0 THEN ' et al.' ELSE '.' END END AS tc,
 CASE WHEN k % 10 = 0 THEN '[S.l.] :' ELSE 'Anytown :' END AS pa, p_brand || ' Press,' AS pb,
 'https://Host' || (k % 10) || '.example.org/item/' || k AS url,
 CASE WHEN k % 11 = 0 THEN 'j' ELSE 'a' END AS kind, CASE WHEN k % 13 = 0 THEN 's' ELSE 'm' END AS level,
 '240101s' || (1950 + p_size) || '    xxu' || repeat(' ', 17) || 'eng d' AS f008,
 '00000n' || CASE WHEN k % 11 = 0 THEN 'j' ELSE 'a' END || CASE WHEN k % 13 = 0 THEN 's' ELSE 'm' END || ' ' || CASE WHEN k % 2 = 0 THEN 'a' ELSE ' ' END || '2200000 ' || CASE WHEN k % 4 = 0 THEN 'i' ELSE 'a' END || ' 4500' AS leader,
 list_concat(list_concat(['001'], CASE WHEN k % 3 <> 0 THEN ['003'] ELSE [] END), list_concat(['008', '020', '040', '050', '100'],
  list_concat(CASE WHEN k % 17 <> 0 THEN ['245'] ELSE [] END, list_concat(CASE WHEN k % 6 = 0 THEN ['250'] ELSE [] END, list_concat([CASE WHEN k % 2 = 0 THEN '260' ELSE '264' END, '300', '650'],
  list_concat(CASE WHEN k % 3 = 0 THEN ['650'] ELSE [] END, list_concat(CASE WHEN k % 8 = 0 THEN ['700'] ELSE [] END, ['856']))))))) AS tags
 FROM c) """


def _sql_field(tag: str, inds: str, value: str, *parts: tuple, when: str = "true") -> str:
    subs = ", ".join(f"CASE WHEN {(*p, 'true')[2]} THEN {{'c': '{p[0]}', 'v': {p[1]}}} END" for p in parts)
    own = f"list_filter([{subs}], lambda x: x IS NOT NULL)" if parts else "NULL"
    return f"CASE WHEN {when} THEN {{'tag': '{tag}', 'inds': '{inds}', 'value': {value}::VARCHAR, 'subs': {own}::STRUCT(c VARCHAR, v VARCHAR)[]}} END"


#: The records' fields for DuckDB: a list of (tag, inds, value, subs), from the values of ``SQL``.
FIELDS_SQL = "list_filter([" + ", ".join([
    _sql_field("001", "", "ctl"),
    _sql_field("003", "", "'SWK'", when="k % 3 <> 0"),
    _sql_field("008", "", "f008"),
    _sql_field("020", "  ", "NULL", ("a", "isbn")),
    _sql_field("040", "  ", "NULL", ("a", "'SWK'"), ("e", "'rda'", "k % 4 = 0")),
    _sql_field("050", " 4", "NULL", ("a", "'QA' || (k % 900 + 1) || '.' || p_size"), ("b", "'.B' || p_size || ' ' || year")),
    _sql_field("100", "1 ", "NULL", ("a", "p_brand || ','"), ("e", "'author'", "k % 4 = 0"), ("0", "'http://id.loc.gov/authorities/names/n' || k", "k % 7 = 0")),
    _sql_field("245", "10", "NULL", ("a", "t1 || ' :'"), ("b", "t2 || ' /'"), ("c", "tc"), when="t1 IS NOT NULL"),
    _sql_field("250", "  ", "NULL", ("a", "'2nd ed.'"), when="k % 6 = 0"),
    _sql_field("260", "  ", "NULL", ("a", "pa"), ("b", "pb"), ("c", "'c' || year || '.'"), when="k % 2 = 0"),
    _sql_field("264", " 1", "NULL", ("a", "pa"), ("b", "pb"), ("c", "'c' || year || '.'"), when="k % 2 <> 0"),
    _sql_field("300", "  ", "NULL", ("a", "p_size || ' p. :'"), ("b", "'ill. ;'"), ("c", "'23 cm'")),
    _sql_field("650", " 0", "NULL", ("a", "p_type || '.'"), ("x", "'Catalogues'")),
    _sql_field("650", " 0", "NULL", ("a", "'Things, ' || p_type"), when="k % 3 = 0"),
    _sql_field("700", "1 ", "NULL", ("a", "'Helper, ' || p_brand"), when="k % 8 = 0"),
    _sql_field("856", "40", "NULL", ("u", "url"), ("y", "'Online'", "k % 3 = 1")),
]) + "], lambda x: x IS NOT NULL)"


def lines_sql(fields: str) -> str:
    """The breaker lines of a list of such fields."""
    subs = "array_to_string(list_transform(f.subs, lambda y: '$' || y.c || y.v), '')"
    return f"list_transform({fields}, lambda f: '=' || f.tag || '  ' || CASE WHEN f.subs IS NULL THEN f.value ELSE replace(f.inds, ' ', chr(92)) || {subs} END)"


def xml_sql(fields: str) -> str:
    """The slim XML of a list of such fields."""
    subs = "array_to_string(list_transform(f.subs, lambda y: '<subfield code=\"' || y.c || '\">' || y.v || '</subfield>'), '')"
    data = f"'<datafield tag=\"' || f.tag || '\" ind1=\"' || f.inds[1] || '\" ind2=\"' || f.inds[2] || '\">' || {subs} || '</datafield>'"
    return f"array_to_string(list_transform({fields}, lambda f: CASE WHEN f.subs IS NULL THEN '<controlfield tag=\"' || f.tag || '\">' || f.value || '</controlfield>' ELSE {data} END), '')"
