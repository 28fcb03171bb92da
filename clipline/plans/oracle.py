"""SQL fragments that rebuild the canonical tables from the sample tables."""

from __future__ import annotations

CTE = {
    "ev": """SELECT user_id AS video_id, epoch_us(ts) AS us,
        (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS t_s,
        event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
    "curve": """SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY us) - 1 AS idx, t_s, value
        FROM ev""",
    "videos": "SELECT video_id, max(t_s) AS duration_s FROM ev GROUP BY video_id",
    "cuts": "SELECT video_id, t_s FROM ev WHERE event_type = 'click'",
    "beats": "SELECT video_id, t_s FROM ev WHERE event_type = 'signup'",
    "speech": """SELECT video_id, t_s AS start_s, t_s + value / 10.0 AS end_s, 'k' || k AS text
        FROM ev WHERE event_type = 'view'""",
    "silence": "SELECT video_id, t_s AS start_s, t_s + value / 20.0 AS end_s FROM ev WHERE event_type = 'error'",
    "texts": "SELECT video_id, t_s, value, 'k' || k AS text FROM ev WHERE event_type = 'purchase'",
    "windows": """SELECT video_id, duration_s, win,
          round(win * 0.5, 1) AS start_s,
          CASE WHEN win < full_n THEN round(win * 0.5 + 1.0, 1) ELSE round(duration_s, 1) END AS end_s
        FROM (SELECT video_id, duration_s, full_n, unnest(range(0, full_n + 1)) AS win FROM
          (SELECT *, CAST(floor((duration_s - 1.0) / 0.5) AS BIGINT) + 1 AS full_n FROM videos
           WHERE duration_s > 1.0))""",
    "totals": """SELECT video_id, count(*) AS n, avg(value) AS mean_value, max(value) AS max_value
        FROM curve GROUP BY video_id""",
    "modules": """SELECT script_id, pos, id, type, label, start_time, duration, track_index, detail FROM (
        SELECT l_orderkey AS script_id,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1
            AS pos,
          'm' || l_linenumber AS id,
          CASE l_returnflag WHEN 'A' THEN 'title' WHEN 'N' THEN 'video_segment' ELSE 'effect' END AS type,
          'part ' || l_partkey AS label,
          (epoch_us(l_shipdate) - min(epoch_us(l_shipdate)) OVER (PARTITION BY l_orderkey)) / 8.64e10 AS start_time,
          CAST(l_quantity AS DOUBLE) AS duration, l_suppkey % 3 AS track_index, l_linestatus AS detail
        FROM lineitem)""",
    "tracks": "SELECT o_orderkey AS script_id, unnest([0, 1]) AS idx FROM orders",
    "scripts": "SELECT o_orderkey AS script_id, o_totalprice / 1000 AS total_duration FROM orders",
    "jobs": """SELECT o_orderkey AS job_id,
          CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status,
          o_orderpriority AS type, o_orderdate AS updated_at, o_totalprice AS elapsed_ms FROM orders""",
    "segments": """SELECT video_id, CAST(floor(t_s / 24) AS BIGINT) AS seg_idx, min(t_s) AS start_s, max(t_s) AS end_s,
          ['opening', 'highlight', 'transition', 'effect', 'closing'][CAST(floor(t_s / 24) AS BIGINT) % 5 + 1]
            AS structure_type, 's' || (count(*) % 3) AS sub_type, list_sort(list_distinct(list(event_type))) AS evidence
        FROM ev GROUP BY video_id, CAST(floor(t_s / 24) AS BIGINT)""",
    "transcript": """SELECT conv_id AS video_id, turn AS seq, text,
          CAST(coalesce(sum(length(text)) OVER w0, 0) AS DOUBLE) / 15.0 AS start_s,
          CAST(sum(length(text)) OVER w1 AS DOUBLE) / 15.0 AS end_s FROM conversations
        WINDOW w0 AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               w1 AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "frames": """SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, vec_id,
          list_transform(embedding, lambda x: CAST(abs(x) AS DOUBLE)) AS hist FROM embeddings""",
    "detections": """SELECT l_orderkey AS frame,
          concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(epoch(l_shipdate) AS BIGINT)) AS det_id,
          CASE l_returnflag WHEN 'A' THEN 'person' WHEN 'N' THEN 'car' ELSE 'dog' END AS class_name,
          1.0::DOUBLE - l_discount AS confidence,
          l_quantity * 20 AS x1, l_linenumber * 100.0::DOUBLE AS y1,
          l_quantity * 20 + (100 + l_discount * 1000) AS x2,
          l_linenumber * 100.0::DOUBLE + (80 + l_tax * 1000) AS y2 FROM lineitem""",
}

_NEEDS = {
    "curve": ["ev"], "videos": ["ev"], "cuts": ["ev"], "beats": ["ev"], "speech": ["ev"], "silence": ["ev"],
    "texts": ["ev"], "windows": ["ev", "videos"], "totals": ["ev", "curve"], "segments": ["ev"],
}


def with_tables(tables: str, body: str, **extra: str) -> str:
    """``WITH`` the named canonical tables (and ``extra`` ones, in order) ``body``."""
    names: list[str] = []
    for name in tables.split():
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in names:
                names.append(needed)
    clauses = [f"{n} AS MATERIALIZED ({CTE[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(clauses) + "\n" if clauses else "") + body
