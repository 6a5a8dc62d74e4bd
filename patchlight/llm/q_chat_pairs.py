"""op2: preference pairs of all conversations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_pairs import format_pairs, preference_pairs


def op2_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_pairs(preference_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x.cast("array<string>"))), ",")
    return made.select(
        "chosen_id", "rejected_id", "answer_id", "n_common", "prompt", "chosen", "rejected", flat("chosen_mask").alias("chosen_mask"), flat("rejected_mask").alias("rejected_mask")
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, count(*) AS n, max({'r': role, 't': text}) FILTER (WHERE k = 1) AS opening, coalesce(max(k) FILTER (WHERE role = 'assistant'), 0) AS answer FROM t GROUP BY conv_id),
drawn AS (
  SELECT *, ('0x' || substr(md5(conv_id::VARCHAR), 1, 8))::BIGINT AS h FROM o),
bucketed AS (
  SELECT *, h % (64 * ceil((SELECT greatest(count(*), 1) FROM o) / 1048576))::BIGINT AS b FROM drawn),
near AS (
  SELECT *, (row_number() OVER (PARTITION BY opening, b ORDER BY conv_id) - 1) // 2 AS pair FROM bucketed),
near2 AS (
  SELECT *, count(*) OVER (PARTITION BY opening, b, pair) AS size FROM near),
far AS (
  SELECT conv_id, n, opening, -1 AS b, (row_number() OVER (PARTITION BY opening ORDER BY conv_id) - 1) // 2 AS pair
  FROM near2 WHERE size = 1),
grouped AS (
  SELECT conv_id, n, opening, b, pair FROM near2 WHERE size = 2 UNION ALL SELECT conv_id, n, opening, b, pair FROM far),
natural_pairs AS (
  SELECT first(conv_id ORDER BY n DESC, conv_id) AS chosen_id,
         CASE WHEN count(*) = 2 THEN last(conv_id ORDER BY n DESC, conv_id) END AS rejected_id
  FROM grouped GROUP BY opening, b, pair),
alone AS (
  SELECT chosen_id, answer, h FROM natural_pairs JOIN drawn ON conv_id = chosen_id WHERE rejected_id IS NULL AND answer > 0),
givers AS (
  SELECT chosen_id, coalesce(lead(chosen_id) OVER w, first(chosen_id) OVER w) AS answer_id FROM alone
  WINDOW w AS (PARTITION BY h % ceil((SELECT count(*) FROM alone) / 64)::BIGINT ORDER BY chosen_id)),
pairs AS (
  SELECT p.chosen_id, p.rejected_id, g.answer_id FROM natural_pairs p LEFT JOIN givers g ON g.chosen_id = p.chosen_id AND p.rejected_id IS NULL AND g.answer_id <> g.chosen_id),
other AS (
  SELECT p.chosen_id, t.k, t.role, t.text FROM pairs p JOIN t ON t.conv_id = p.rejected_id
  UNION ALL SELECT p.chosen_id, t.k, t.role, t.text FROM pairs p JOIN o ON o.conv_id = p.chosen_id JOIN t ON t.conv_id = p.chosen_id AND t.k < o.answer WHERE p.answer_id IS NOT NULL
  UNION ALL SELECT p.chosen_id, o.answer, t.role, t.text FROM pairs p JOIN o ON o.conv_id = p.chosen_id JOIN o a ON a.conv_id = p.answer_id JOIN t ON t.conv_id = p.answer_id AND t.k = a.answer),
met AS (
  SELECT p.*, c.k, (r.role IS NULL OR r.role <> c.role OR r.text <> c.text) AS differs
  FROM pairs p JOIN t c ON c.conv_id = p.chosen_id LEFT JOIN other r ON r.chosen_id = p.chosen_id AND r.k = c.k),
lens AS (
  SELECT m.chosen_id, rejected_id, answer_id,
         CASE WHEN rejected_id IS NULL AND answer_id IS NULL THEN greatest(max(o.answer) - 1, 0)
              ELSE coalesce(min(k) FILTER (WHERE differs), max(k) + 1) - 1 END AS n_common
  FROM met m JOIN o ON o.conv_id = m.chosen_id GROUP BY 1, 2, 3),
sides AS (
  SELECT l.chosen_id, l.n_common, 'c' AS side, k, role, text FROM lens l JOIN t ON t.conv_id = l.chosen_id
  UNION ALL SELECT l.chosen_id, l.n_common, 'r', k, role, text FROM lens l JOIN other USING (chosen_id)),
marked AS (
  SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS x FROM sides),
placed AS (
  SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY chosen_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM marked WHERE k > n_common),
done AS (
  SELECT chosen_id, side, string_agg(x, '' ORDER BY k) AS x,
         coalesce(string_agg((pos + length(role) + 13)::BIGINT || '-' || (pos + length(x) - 1)::BIGINT, ',' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS mask
  FROM placed GROUP BY 1, 2),
prompts AS (
  SELECT chosen_id, string_agg(x, '' ORDER BY k) AS prompt FROM marked WHERE side = 'c' AND k <= n_common GROUP BY 1)
SELECT l.chosen_id, l.rejected_id, l.answer_id, l.n_common::INT AS n_common, coalesce(p.prompt, '') AS prompt,
       coalesce(c.x, '') AS chosen, coalesce(r.x, '') AS rejected, coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM lens l LEFT JOIN prompts p USING (chosen_id)
LEFT JOIN done c ON c.chosen_id = l.chosen_id AND c.side = 'c' LEFT JOIN done r ON r.chosen_id = l.chosen_id AND r.side = 'r'
"""
