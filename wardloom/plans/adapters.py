"""The domain's tables as views over the driver's tables.

Each view is one SQL text that Spark and DuckDB read alike, so that a query
and its oracle start from the same rows.  ``{name}`` is a table of the driver.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

from wardloom.operators.ranking import numbered

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Tables with a number within a key: name to (table, rows, key, order, number).  DuckDB has them as windows, Spark by ranges of
#: the order column, so that no key is numbered by one task.
NUMBERED = {
    "customer_n": ("customer", "SELECT * FROM {customer}", "c_nationkey", "c_custkey", "n_serial"),
    "event_n": ("events", "SELECT *, concat('t', CAST(user_id % 5 AS STRING)) AS candidate FROM {events}", "candidate", "event_id", "n_seq"),
}

VIEWS: dict[str, str] = {
    "roll": """
        SELECT ward, serial, pos, name, relative, age, gender, ward * 10 + CAST(FLOOR(serial / 400.0) AS BIGINT) + 1 AS booth,
            CASE WHEN pos % 53 = 0 THEN NULL WHEN pos % 7 = 0 THEN CAST(n AS STRING) WHEN pos % 7 = 1 THEN translate(CAST(n AS STRING), '0123456789', '०१२३४५६७८९')
                WHEN pos % 7 = 2 THEN concat(' ', CAST(n AS STRING), ' ') WHEN pos % 7 = 3 THEN concat(CAST(n AS STRING), ' / 2')
                WHEN pos % 7 = 4 THEN concat(CAST(n AS STRING), '/२') WHEN pos % 7 = 5 THEN concat(CAST(n AS STRING), 'A') ELSE concat(CAST(n AS STRING), 'a') END AS house,
            CASE WHEN pos % 3 = 0 THEN NULL ELSE concat('RJ', lpad(CAST(pos AS STRING), 7, '0')) END AS epic, pos % 11 = 0 AS struck
        FROM (SELECT CAST(c_nationkey + 1 AS BIGINT) AS ward, CAST(n_serial AS BIGINT) AS serial,
                c_custkey AS pos, p_name AS name, p_type AS relative, CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE CAST(18 + c_custkey % 70 AS INT) END AS age,
                CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, CAST(CAST(FLOOR(c_custkey / 200.0) AS BIGINT) + 1 AS INT) AS n
            FROM customer_n JOIN {part} ON p_partkey = c_custkey) numbered""",
    "supp": """
        SELECT roll.ward, CASE WHEN o_custkey % 13 = 0 THEN serial + 100000 ELSE serial END AS serial, CAST(year(o_orderdate) AS INT) AS pub,
            o_orderkey AS pos, concat(name, ' ', CAST(o_orderkey % 5 AS STRING)) AS name, o_orderstatus = 'F' AS struck
        FROM {orders} JOIN roll ON o_custkey = roll.pos""",
    "sync_log": """
        SELECT candidate, CAST(n_seq AS BIGINT) AS seq, updated_at, device, event_id,
            CASE kind WHEN 'none' THEN concat('mark:', w) ELSE concat(kind, ':', w, ':', CAST(s AS STRING)) END AS id,
            CASE WHEN event_id % 23 = 0 THEN '' ELSE concat('ct', CAST(event_id AS STRING)) END AS ciphertext,
            CASE WHEN event_id % 29 = 0 THEN NULL ELSE concat('iv', CAST(event_id AS STRING)) END AS iv,
            CASE WHEN event_id % 47 = 0 THEN NULL
                WHEN kind = 'mark' THEN concat('{"wardId":"', w, '","serial":', CAST(s + CASE WHEN event_id % 41 = 0 THEN 1 ELSE 0 END AS STRING),
                    ',"workerId":"', CASE WHEN event_id % 43 = 0 THEN '' ELSE concat('w', CAST(device % 20 AS STRING)) END, '","markedAt":"e', CAST(event_id AS STRING), '"}')
                WHEN kind = 'contact' THEN concat('{"wardId":"', w, '","serial":', CAST(s AS STRING), ',"phone":',
                    CASE WHEN event_id % 37 = 0 THEN '"12"' WHEN event_id % 4 = 0 THEN 'null' ELSE concat('"098', lpad(CAST(event_id AS STRING), 8, '0'), '"') END,
                    CASE WHEN event_id % 7 = 0 THEN ',"revoked":true' ELSE '' END, ',"consentAt":"', CASE WHEN event_id % 53 = 0 THEN '' ELSE concat('e', CAST(event_id AS STRING)) END, '"}')
                ELSE '{}' END AS data
        FROM (SELECT candidate, n_seq, event_id, user_id AS device, ts AS updated_at,
                CAST(event_id % 7 + 1 AS STRING) AS w, 1 + CAST(FLOOR(value) AS BIGINT) AS s,
                CASE WHEN event_type IN ('click', 'view') THEN 'mark' WHEN event_type IN ('purchase', 'signup') THEN 'contact' ELSE 'none' END AS kind
            FROM event_n) keyed""",
    "marks": """
        SELECT candidate, CAST(split_part(id, ':', 2) AS BIGINT) AS ward, CAST(split_part(id, ':', 3) AS BIGINT) AS serial,
            concat('w', CAST(device % 20 AS STRING)) AS worker, updated_at AS marked_at, seq
        FROM sync_log WHERE id LIKE 'mark:%:%'""",
    "contacts": """
        SELECT candidate, CAST(split_part(id, ':', 2) AS BIGINT) AS ward, CAST(split_part(id, ':', 3) AS BIGINT) AS serial,
            CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 5 = 0 THEN concat('+91 98', lpad(CAST(event_id AS STRING), 8, '0')) ELSE concat('098', lpad(CAST(event_id AS STRING), 8, '0')) END AS phone,
            event_id % 7 = 0 AS revoked, updated_at AS consent_at, seq
        FROM sync_log WHERE id LIKE 'contact:%'""",
    "assignments": """
        SELECT s_suppkey AS serial, concat('w', CAST(s_nationkey AS STRING)) AS worker_id, s_name AS worker_name FROM {supplier}""",
    "tags": """
        SELECT concat(CAST(1 + doc_id % 25 AS STRING), ':', CAST(1 + doc_id % 60 AS STRING)) AS voter_key, CASE WHEN quality = 1 THEN 'supporter' ELSE 'undecided' END AS value FROM {labels}""",
    "visits": """
        SELECT concat(CAST(1 + doc_id % 25 AS STRING), ':', CAST(1 + doc_id % 40 AS STRING)) AS voter_key, CASE WHEN toxic = 1 THEN 'no one home' ELSE 'met' END AS value FROM {labels}""",
    "cat_ward": """
        SELECT CAST(r_regionkey AS BIGINT) AS district_id, r_name AS district, CAST(n_nationkey AS BIGINT) AS samiti_id, n_name AS samiti, s_suppkey AS panchayat_id, s_name AS panchayat,
            CAST(l_linenumber AS INT) AS ward, MAX(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) = 1 AS final, MAX(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = 1 AS supplement
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
        GROUP BY r_regionkey, r_name, n_nationkey, n_name, s_suppkey, s_name, l_linenumber""",
    "cat_samiti": """
        SELECT CAST(n_regionkey AS BIGINT) AS district_id, CAST(n_nationkey AS BIGINT) AS samiti_id,
            concat(n_name, CASE WHEN n_nationkey % 5 = 3 THEN ' NAGAR PALIKA' WHEN n_nationkey % 5 = 4 THEN ' ZILLA PARISHAD' ELSE ' PANCHAYAT SAMITI' END) AS samiti
        FROM {nation} WHERE n_regionkey <> 4""",
    "cat_panchayat": """
        SELECT CAST(s_nationkey AS BIGINT) AS samiti_id, s_suppkey AS panchayat_id, s_name AS panchayat FROM {supplier} WHERE s_nationkey % 6 <> 2""",
    "cat_grid": """
        SELECT panchayat_id, CAST(row_number() OVER (PARTITION BY panchayat_id ORDER BY ward) AS INT) AS row_no,
            CASE WHEN panchayat_id % 19 = 0 AND ward = 3 THEN 'x' WHEN panchayat_id % 23 = 0 AND ward = 4 THEN '2' ELSE CAST(ward AS STRING) END AS ward_text,
            CASE WHEN panchayat_id % 17 = 0 AND ward = 2 THEN concat(panchayat, ' B') ELSE panchayat END AS name,
            final AND NOT (panchayat_id % 29 = 0 AND ward = 1) AS final, supplement
        FROM cat_ward WHERE panchayat_id % 31 <> 0""",
    "lines": """
        SELECT conv_id AS doc, turn AS pos, CASE WHEN role = 'user' THEN 0.0 ELSE 2.0 END AS x, CAST(turn - turn % 2 AS DOUBLE) AS y, role = 'user' AS is_start, text FROM {conversations}""",
    "expected": """
        SELECT c_custkey AS serial, c_name AS name, c_mktsegment AS house, CAST(18 + c_custkey % 70 AS INT) AS age, c_custkey % 11 = 0 AS struck FROM {customer}""",
    "decoded": """
        SELECT serial, CAST(1 + CAST(FLOOR(serial / 27.0) AS BIGINT) AS INT) AS page, CASE WHEN serial % 31 = 0 THEN concat(name, '?') ELSE name END AS name, house,
            CASE WHEN serial % 62 = 0 THEN NULL ELSE age END AS age, struck
        FROM expected WHERE serial % 29 <> 0""",
}


def _needs(sql: str) -> list[str]:
    return [v for v in (*NUMBERED, *VIEWS) if re.search(rf"\b(FROM|JOIN)\s+{v}\b", sql)]


def _with(sql: str, place, numbered) -> str:
    """``sql`` after a WITH of the views it reads, and those that they read; ``numbered`` gives the text of a numbered table."""
    wanted: dict[str, str] = {}

    def add(text: str) -> None:
        for v in _needs(text):
            if v not in wanted:
                body = VIEWS[v] if v in VIEWS else numbered(v)
                add(body)
                wanted[v] = body

    add(sql)
    ctes = ",\n".join(f"{v} AS ({body})" for v, body in wanted.items())
    # a text that has a WITH of its own goes on with it
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, flags=re.I)
    kind = "WITH RECURSIVE" if head and head[1] else "WITH"
    whole = f"{kind} {ctes}" + (",\n" + sql[head.end() :] if head else "\n" + sql) if wanted else sql
    return re.sub(r"\{(\w+)\}", lambda m: place(m[1]) if m[1] in TABLES else m[0], whole)


def oracle(sql: str) -> str:
    """SQL for DuckDB, where the driver's tables are views."""

    def window(name: str) -> str:
        _, rows, key, order, number = NUMBERED[name]
        return f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS {number} FROM ({rows}) r"

    return _with(sql, lambda t: t, window)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of this module, or a table of the driver."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    path = lambda t: f"parquet.`{sf_dir}/{t}.parquet`"

    def by_ranges(name: str) -> str:
        table, rows, key, order, number = NUMBERED[name]
        made = f"wardloom_{name}_{zlib.crc32(sf_dir.encode())}"
        numbered(spark.sql(rows.format(**{table: path(table)})), [key], order, number).createOrReplaceTempView(made)
        return f"SELECT * FROM {made}"

    return spark.sql(_with(f"SELECT * FROM {name}", path, by_ranges))
