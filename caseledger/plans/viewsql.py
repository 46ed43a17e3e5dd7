"""SQL text of the adapter views, for the oracle side only."""

from __future__ import annotations

SQL: dict[str, str] = {
    "v_cohort": """
 SELECT CAST(o_orderkey AS VARCHAR) AS study_id, CAST(o_custkey AS VARCHAR) AS patient_id,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'train'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'validation' ELSE 'test' END AS locked_partition,
  o_orderstatus AS source_group,
  CASE WHEN o_totalprice > 350000 THEN 'lesion' ELSE 'non-lesion' END AS diagnostic_label,
  CASE WHEN o_totalprice > 350000 THEN 1 ELSE 0 END AS label_binary,
  CASE WHEN o_orderkey % 2 = 0 THEN 'manual' ELSE 'automatic' END AS annotation_type
 FROM orders""",
    "v_candidate": """
 SELECT c.study_id, floor(l_extendedprice / 1000.0::DOUBLE) / 100.0::DOUBLE AS candidate_score,
  l_partkey AS candidate_x, l_suppkey AS candidate_y, CAST(l_linenumber AS BIGINT) AS candidate_z,
  date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS shipped, label_binary,
  CASE WHEN label_binary = 1 THEN l_quantity END AS reference_distance_mm
 FROM lineitem JOIN v_cohort c ON c.study_id = CAST(l_orderkey AS VARCHAR)""",
    "v_case": """
 SELECT c.*, coalesce(least(d, 1.0::DOUBLE), 0.0::DOUBLE) AS organ_dice,
  CASE WHEN label_binary = 1 THEN coalesce(least(tx, 1.0::DOUBLE), 0.0::DOUBLE) END AS lesion_dice,
  CASE WHEN label_binary = 1 THEN coalesce(q, 0) * 30 ELSE 0 END AS lesion_voxels,
  coalesce(best, 0.0::DOUBLE) AS maximum_candidate_score,
  label_binary = 1 AND coalesce(closest <= 5, FALSE) AS lesion_localized,
  coalesce(best >= 0.9::DOUBLE, FALSE) AS case_positive, coalesce(q > 20, FALSE) AS target_present
 FROM v_cohort c LEFT JOIN (
  SELECT CAST(l_orderkey AS VARCHAR) AS study_id, floor(sum(l_discount) * 1000 + 0.5::DOUBLE) / 1000 AS d,
   floor(sum(l_tax) * 1000 + 0.5::DOUBLE) / 1000 AS tx, CAST(sum(l_quantity) AS BIGINT) AS q,
   max(floor(l_extendedprice / 1000) / 100) AS best, min(l_quantity) AS closest
  FROM lineitem GROUP BY 1) USING (study_id)""",
    "v_arm_case": """
 SELECT study_id, patient_id, diagnostic_label, label_binary, annotation_type, 'pretrained' AS arm,
  12 AS best_epoch, organ_dice, lesion_dice, maximum_candidate_score AS case_score FROM v_case
 UNION ALL
 SELECT study_id, patient_id, diagnostic_label, label_binary, annotation_type, 'scratch', 17,
  organ_dice * 0.5::DOUBLE, 1.0::DOUBLE - lesion_dice, organ_dice FROM v_case""",
    "v_ledger": """
 SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS study_id, event_type AS status, value AS score,
  ts AS completed_at, event_id AS seq FROM events""",
    "v_history": """
 SELECT event_type AS arm, event_id AS epoch, value AS score, event_id % 3 = 0 AS validated FROM events""",
    "v_volume": """
 SELECT CAST(vec_id AS VARCHAR) AS study_id, CAST(i // 16 AS INT) AS x, CAST((i // 4) % 4 AS INT) AS y,
  CAST(i % 4 AS INT) AS z, f * 1000 AS ct,
  CASE WHEN f > 0.15::DOUBLE THEN 1 WHEN f > 0.02::DOUBLE THEN 4 ELSE 0 END AS label,
  least(greatest(0.5::DOUBLE + f * 2, 0::DOUBLE), 1::DOUBLE) AS p_lesion,
  least(greatest(0.4::DOUBLE - f, 0::DOUBLE), 1::DOUBLE) AS p_organ
 FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS f,
              unnest(range(len(embedding))) AS i FROM embeddings)""",
    "v_tiled": """
 SELECT 'tiled' AS study_id, CAST((vec_id % 5) * 4 + i // 16 AS INT) AS x, CAST((vec_id // 5 % 5) * 4 + (i // 4) % 4 AS INT) AS y,
  CAST((vec_id // 25) * 4 + i % 4 AS INT) AS z,
  least(greatest(0.5::DOUBLE + f * 2, 0::DOUBLE), 1::DOUBLE) AS p_lesion,
  least(greatest(0.4::DOUBLE - f, 0::DOUBLE), 1::DOUBLE) AS p_organ
 FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS f, unnest(range(len(embedding))) AS i FROM embeddings)""",
    "v_points": """
 SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS study_id, CAST(l_partkey % 60 AS INT) AS x,
  CAST(l_orderkey % 48 AS INT) AS y, CAST(l_linenumber * 4 + l_orderkey % 4 AS INT) AS z
 FROM lineitem""",
    "v_probe": """
 SELECT o_orderkey AS probe_id, CAST(o_orderkey % 100 AS VARCHAR) AS study_id, CAST(o_custkey % 60 AS INT) AS x,
  CAST(o_orderkey % 47 AS INT) AS y, CAST(o_custkey % 31 AS INT) AS z FROM orders""",
    "v_box": """
 SELECT CAST(p_partkey AS VARCHAR) AS study_id, p_partkey AS k,
  (p_partkey % 41) * 0.5::DOUBLE + 20 AS cx, (p_partkey % 37) * 0.5::DOUBLE + 20 AS cy,
  (p_partkey % 29) * 0.5::DOUBLE + 20 AS cz,
  (p_partkey % 23) * 0.25::DOUBLE + 12 AS x0, (p_partkey % 31) * 0.25::DOUBLE + 12 AS y0,
  (p_partkey % 19) * 0.25::DOUBLE + 12 AS z0,
  (p_partkey % 23) * 0.25::DOUBLE + 14 + p_size AS x1, (p_partkey % 31) * 0.25::DOUBLE + 14 + p_size AS y1,
  (p_partkey % 19) * 0.25::DOUBLE + 14 + p_size AS z1,
  (p_partkey % 3) * 0.25::DOUBLE + 0.5::DOUBLE AS sx, (p_partkey % 5) * 0.25::DOUBLE + 0.5::DOUBLE AS sy,
  (p_partkey % 4) * 0.25::DOUBLE + 0.5::DOUBLE AS sz,
  p_partkey % 50 + 20 AS nx, p_partkey % 60 + 20 AS ny, p_partkey % 70 + 20 AS nz,
  list_extract(['LPS','RAS','LPI','PSL','SRA'], CAST(p_partkey % 5 + 1 AS BIGINT)) AS orientation,
  CASE WHEN p_partkey % 3 = 0 THEN 'manual' ELSE 'automatic' END AS annotation_type,
  CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS label_binary FROM part""",
    "v_payload": """
 SELECT '/old/root/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
  CAST(doc_id AS VARCHAR) AS study_id, text AS content FROM documents""",
}

_NEEDS = {"v_candidate": ("v_cohort",), "v_case": ("v_cohort",), "v_arm_case": ("v_case",)}


def with_views(uses: tuple[str, ...], body: str) -> str:
    """``WITH`` clause of the named views and what they need, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in uses:
        add(name)
    body = body.strip()
    parts = [f"{n} AS ({SQL[n]})" for n in order]
    if body.startswith(","):
        head, body = (",\n".join(parts) + body) if parts else body[1:], ""
        return "WITH RECURSIVE " + head
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" + body) if parts else body
