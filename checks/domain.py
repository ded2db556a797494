"""The given tables read as file-access data. The SQL text runs unchanged on Spark and DuckDB."""

from __future__ import annotations

import re

_SUFFIX = ("CASE {k} % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' WHEN 2 THEN '.DAT' WHEN 3 THEN '.tar.gz' ELSE '' END")


def _path(key: str) -> str:
    return (f"concat('/mnt/data/d', CAST({key} % 7 AS STRING), '/f', CAST({key} AS STRING), "
            + _SUFFIX.format(k=key) + ")")


SQL = {
    "accesses": f"""
SELECT event_id AS id, {_path('user_id')} AS file_path,
  CASE WHEN event_type IN ('signup','purchase') THEN 'write' ELSE 'read' END AS access_type,
  ts AS access_time,
  CASE WHEN event_type IN ('signup','purchase') THEN CAST(0 AS BIGINT) ELSE CAST(floor(value * 1024) AS BIGINT) END AS read_size,
  CASE WHEN event_type IN ('signup','purchase') THEN CAST(floor(value * 1024) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS write_size
FROM events""",
    "files": f"""
SELECT {_path('c_custkey')} AS file_path,
  CAST(floor(abs(c_acctbal) * 100000) AS BIGINT) AS file_size,
  CAST(64 * power(2, c_custkey % 7) AS BIGINT) AS chunk_size
FROM customer""",
    "transfers": f"""
SELECT o_orderkey AS ingest_id, {_path('o_custkey')} AS file_path,
  o_orderdate AS start_time, CAST(o_orderkey % 6 AS DOUBLE) AS elapsed_s,
  CAST(floor(o_totalprice * 1000) AS BIGINT) AS bytes_transferred,
  CASE WHEN o_orderstatus = 'F' THEN 'write' ELSE 'read' END AS operation_type
FROM orders""",
    "bench_log": """
SELECT l.l_orderkey AS k1, l.l_linenumber AS k2, l.l_shipdate AS k3,
  concat('/mnt/data/testdir_', CAST(CAST(64 * power(2, p.p_size % 7) AS BIGINT) AS STRING), 'K/test_', CAST(p.p_partkey AS STRING), '.dat') AS file_path,
  CAST(64 * power(2, p.p_size % 10) AS BIGINT) AS file_size_kb,
  CAST(64 * power(2, l.l_linenumber % 7) AS BIGINT) AS chunk_size_kb,
  CAST(l.l_quantity AS BIGINT) + CAST(l.l_linenumber AS BIGINT) AS access_count,
  l.l_discount * 1000 AS avg_read_kb, l.l_tax * 1000 AS avg_write_kb,
  CAST(floor(l.l_discount * 2000) AS BIGINT) AS max_read_kb, CAST(floor(l.l_tax * 2000) AS BIGINT) AS max_write_kb,
  CAST(l.l_quantity AS BIGINT) AS read_ops, CAST(l.l_linenumber AS BIGINT) AS write_ops,
  l.l_extendedprice AS throughput_kbps
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "history": """
SELECT concat('/mnt/data/f', CAST(l_partkey AS STRING)) AS file_path,
  CAST(64 * power(2, l_linenumber % 7) AS BIGINT) AS old_chunk_size,
  CAST(64 * power(2, CAST(l_quantity AS BIGINT) % 7) AS BIGINT) AS new_chunk_size,
  l_shipdate AS optimization_time
FROM lineitem""",
    "trials": """
SELECT o_orderkey AS trial_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'rf' ELSE 'xgb' END AS model_type,
  CASE o_orderkey % 3 WHEN 0 THEN 10.0e0 WHEN 1 THEN 100.0e0 ELSE 1024.0e0 END AS file_size_mb,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'read_heavy' WHEN '2-HIGH' THEN 'write_heavy' WHEN '3-MEDIUM' THEN 'mixed'
       WHEN '4-NOT SPECIFIED' THEN 'sequential' ELSE 'random' END AS access_pattern,
  CAST(512 AS BIGINT) AS old_chunk_size,
  CAST(64 * power(2, o_custkey % 7) AS BIGINT) AS new_chunk_size,
  CAST(o_custkey % 200 AS DOUBLE) AS before_read_speed,
  CAST(o_custkey % 200 AS DOUBLE) * (0.8e0 + o_totalprice / 1000000.0e0) AS after_read_speed,
  CAST(40 + o_custkey % 90 AS DOUBLE) AS before_write_speed,
  CAST(40 + o_custkey % 90 AS DOUBLE) * (0.9e0 + o_totalprice / 2000000.0e0) AS after_write_speed
FROM orders""",
    # The bench log in the v1 columns: bytes and MB/s.
    "v1": """
SELECT k1, k2, k3, file_path, file_size_kb * 1024 AS file_size, chunk_size_kb * 1024 AS chunk_size, access_count,
  avg_read_kb * 1024 AS avg_read_size, avg_write_kb * 1024 AS avg_write_size,
  max_read_kb * 1024 AS max_read_size, max_write_kb * 1024 AS max_write_size,
  read_ops AS read_count, write_ops AS write_count, throughput_kbps / 1024.0e0 AS throughput_mbps
FROM bench_log""",
}

# Built by operators on the Spark side; here only what DuckDB needs to check them.
ORACLE_ONLY = {
    "tput": """
SELECT ingest_id, file_path, start_time, start_time + to_seconds(elapsed_s) AS end_time, elapsed_s, bytes_transferred,
  operation_type, (bytes_transferred / elapsed_s) / 1048576.0e0 AS throughput_mbps
FROM transfers WHERE elapsed_s > 0""",
    "trial_results": """
SELECT *, CASE WHEN before_read_speed > 0 THEN (after_read_speed - before_read_speed) / before_read_speed * 100 ELSE 0 END AS read_speed_pct,
  CASE WHEN before_write_speed > 0 THEN (after_write_speed - before_write_speed) / before_write_speed * 100 ELSE 0 END AS write_speed_pct,
  CASE WHEN before_throughput > 0 THEN (after_throughput - before_throughput) / before_throughput * 100 ELSE 0 END AS throughput_pct
FROM (SELECT *, (before_read_speed + before_write_speed) / 2 AS before_throughput,
        (after_read_speed + after_write_speed) / 2 AS after_throughput FROM trials)""",
    "profiles": """
SELECT f.file_path, f.file_size, f.chunk_size, coalesce(a.access_count, 0) AS access_count, a.avg_read_size, a.avg_write_size,
  a.max_read_size, a.max_write_size, coalesce(a.read_count, 0) AS read_count, coalesce(a.write_count, 0) AS write_count, t.throughput_mbps
FROM files f
LEFT JOIN (SELECT file_path, count(*) AS access_count, avg(read_size) AS avg_read_size, avg(write_size) AS avg_write_size,
    max(read_size) AS max_read_size, max(write_size) AS max_write_size,
    count(*) FILTER (WHERE access_type = 'read') AS read_count, count(*) FILTER (WHERE access_type = 'write') AS write_count
  FROM accesses GROUP BY file_path) a USING (file_path)
LEFT JOIN (SELECT file_path, avg(throughput_mbps) AS throughput_mbps FROM tput GROUP BY file_path) t USING (file_path)""",
    "features": """
SELECT file_path, file_size, chunk_size,
  CASE WHEN u THEN CASE t WHEN 0 THEN 15 WHEN 1 THEN 30 ELSE 70 END ELSE access_count END AS access_count,
  CAST(CASE WHEN u THEN CASE t WHEN 0 THEN 4096 WHEN 1 THEN 65536 ELSE 1048576 END ELSE ar END AS DOUBLE) AS avg_read_size,
  CAST(CASE WHEN u THEN CASE t WHEN 0 THEN 4096 WHEN 1 THEN 32768 ELSE 524288 END ELSE aw END AS DOUBLE) AS avg_write_size,
  CAST(CASE WHEN u THEN CASE t WHEN 0 THEN 8192 WHEN 1 THEN 131072 ELSE 4194304 END ELSE coalesce(nullif(max_read_size, 0), ar * 2) END AS DOUBLE) AS max_read_size,
  CAST(CASE WHEN u THEN CASE t WHEN 0 THEN 8192 WHEN 1 THEN 65536 ELSE 1048576 END ELSE coalesce(nullif(max_write_size, 0), aw * 2) END AS DOUBLE) AS max_write_size,
  CASE WHEN u THEN CASE t WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 50 END ELSE read_count END AS read_count,
  CASE WHEN u THEN CASE t WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 20 END ELSE write_count END AS write_count,
  CAST(CASE WHEN u THEN CASE t WHEN 0 THEN 50 WHEN 1 THEN 100 ELSE 150 END ELSE coalesce(nullif(throughput_mbps, 0), 100) END AS DOUBLE) AS throughput_mbps
FROM (SELECT *, access_count = 0 AS u, CASE WHEN file_size < 1048576 THEN 0 WHEN file_size < 104857600 THEN 1 ELSE 2 END AS t,
        coalesce(nullif(avg_read_size, 0), 4096) AS ar, coalesce(nullif(avg_write_size, 0), 4096) AS aw FROM profiles)""",
    "banded": """
SELECT *, CASE WHEN access_count <= 10 THEN 1 WHEN access_count <= 20 THEN 2 ELSE 3 END AS access_count_label FROM bench_log""",
    "codebook": """
SELECT unit // 4 AS i, unit % 4 AS j, list(m ORDER BY pos) AS weights
FROM (SELECT vec_id % 16 AS unit, pos, avg(v) AS m
      FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
      GROUP BY 1, 2)
GROUP BY unit""",
    "assigned": """
SELECT vec_id, i, j, distance, chunk_size_kb FROM (
  SELECT e.vec_id, c.i, c.j, list_distance(CAST(e.embedding AS DOUBLE[]), c.weights) AS distance,
    CAST(64 * power(2, e.vec_id % 7) AS BIGINT) AS chunk_size_kb,
    row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), c.weights), c.i, c.j) AS rn
  FROM embeddings e CROSS JOIN codebook c) WHERE rn = 1""",
    "unit_map": """
SELECT i, j, chunk FROM (
  SELECT g.i, g.j, m.chunk, row_number() OVER (PARTITION BY g.i, g.j ORDER BY (m.i - g.i) * (m.i - g.i) + (m.j - g.j) * (m.j - g.j), m.i, m.j) AS rn
  FROM (SELECT a.r AS i, b.r AS j FROM range(6) a(r) CROSS JOIN range(6) b(r)) g
  CROSS JOIN (SELECT i, j, avg(chunk_size_kb) AS chunk FROM assigned GROUP BY i, j) m) WHERE rn = 1""",
    "scored_rows": """
SELECT k1, k2, k3, CAST(throughput_kbps > 50000 AS INT) AS label,
  0.3e0 * CAST(throughput_kbps > 50000 AS INT) + 0.7e0 * ((k1 * 7919 + k2 * 131) % 1000) / 1000.0e0 AS p
FROM bench_log""",
}

_ALL = {**SQL, **ORACLE_ONLY}


def needs(name: str) -> list[str]:
    """The derived tables ``name`` reads, in order, then itself."""
    found = []
    for other in re.findall(r"\b(?:FROM|JOIN) (\w+)", _ALL[name]):
        if other in _ALL:
            found += [n for n in needs(other) if n not in found]
    return [*found, name]


def with_tables(sql: str) -> str:
    """``sql`` with a common table expression for every derived table it reads."""
    order: list[str] = []
    for name in re.findall(r"\b(?:FROM|JOIN) (\w+)", sql):
        if name in _ALL:
            order += [n for n in needs(name) if n not in order]
    ctes = ",\n".join(f"{n} AS ({_ALL[n].strip()})" for n in order)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
