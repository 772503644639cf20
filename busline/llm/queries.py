"""The registered queries of this folder. Importing it fills the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from busline.llm import banding, bayes, jumphash, merkle, pieces, pii, postings, quotes, setsketch, trigrams, turns, votes, winnow
from busline.llm.common import documents, stored
from busline.llm.registry import ORACLES, QUERIES, query  # noqa: F401

SHARDS = 24


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def spans_sql(kinds: list[tuple[str, str, str]]) -> str:
    """SQL for (r, kind, n, start, stop): all spans of (kind, expression, test on the match ``m``) in ``d`` (r, body).

    Gaps between matches come from splitting at the same expression; running lengths give the offsets.
    """
    def one(n: int, kind: str, pattern: str, test: str) -> str:
        pattern = pattern.replace("'", "''")
        return f"""SELECT r, '{kind}' AS kind, {n} AS n, e - length(m) AS start, e AS stop FROM (
          SELECT r, m, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY k) AS e FROM (
            SELECT r, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS k FROM (
              SELECT r, regexp_extract_all(body, '{pattern}') AS ms, string_split_regex(body, '{pattern}') AS gs FROM d)))
          WHERE {test}"""
    return " UNION ALL ".join(one(n, *kind) for n, kind in enumerate(kinds))


@query("op5_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded; digests of the ids and of the decoded text."""
    vocabulary = pieces.Vocabulary.load(tokenizer_path())
    coded = pieces.encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary)
    return pieces.decode(coded.select("doc_id", "ids"), vocabulary).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


JUMP_SQL = f"""
WITH RECURSIVE jumps AS (
  SELECT doc_id, n, coalesce(doc_id, 0)::HUGEINT AS state, 0::BIGINT AS shard, 0::BIGINT AS ahead
  FROM (SELECT DISTINCT doc_id FROM documents), (VALUES ({SHARDS}), ({SHARDS + 1})) t(n)
  UNION ALL
  SELECT doc_id, n, s, ahead, floor((ahead + 1) * (2147483648.0::DOUBLE / ((s >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM jumps WHERE ahead < n)),
landed AS (SELECT doc_id, n, max(shard) AS shard FROM jumps GROUP BY ALL)
"""


#: CTE with the table of the bytewise CRC-32.
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of a short text of ASCII, next to ``CRC_TABLE``."""
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), " \
           "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


@query("op9_jump_shards", JUMP_SQL + ", " + CRC_TABLE + """,
spelt AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (SELECT doc_id, n, xor(list_reduce(list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM spelt, crc_table)
SELECT doc_id, summed.n + 8 AS size, crc AS text_crc32, 'key' AS law, a.shard::INT AS shard,
  row_number() OVER (PARTITION BY a.shard ORDER BY doc_id) - 1 AS slot, b.shard::INT AS grown_shard
FROM summed JOIN (SELECT * FROM landed WHERE n = """ + str(SHARDS) + """) a USING (doc_id)
JOIN (SELECT * FROM landed WHERE n = """ + str(SHARDS + 1) + """) b USING (doc_id)""")
def jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to shards by the jump hash of doc_id."""
    return jumphash.assign(documents(spark, sf_dir).select("doc_id", "text"), SHARDS)


@query("op1_decontamination", r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS p, least(13, len(w)) AS n
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
cand AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS p, len(w) AS total
    FROM pos, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)),
hit AS (SELECT DISTINCT r, i, cand.n, item_id FROM cand JOIN win USING (p)),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r),
held AS (SELECT r, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN held USING (r)""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the windows of 13 words of all benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return postings.decontaminate(documents(spark, sf_dir), items).drop("items", "text_key")


def _secrets_sql() -> str:
    kinds = []
    for rule in trigrams.RULES:
        pattern = ("(?i)" if rule.any_case else "") + rule.pattern
        test = f"length(regexp_extract(m, '{pattern.replace(chr(39), chr(39) * 2)}', {rule.group})) >= {rule.least}"
        kinds.append((rule.kind, pattern, test))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in trigrams.BASE)
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS body FROM documents),
s AS ({spans_sql(kinds)}),
t AS (SELECT r, n, kind, start, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS v FROM s)
SELECT doc_id, {counts}, sha256(coalesce(string_agg(v, ',' ORDER BY start, n) FILTER (kind IN {trigrams.BASE}), '')) AS base_sha256,
  coalesce(string_agg(v, ',' ORDER BY start, n), '') AS spans FROM d LEFT JOIN t USING (r) GROUP BY d.r, doc_id"""


@query("op8_secrets", _secrets_sql())
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: the base kinds, and the further kinds of the rule set."""
    found = trigrams.scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"].isin(*trigrams.BASE))
    return found.select("doc_id", *[count_of("secrets", k) for k in trigrams.BASE],
                        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("secrets")).alias("spans"))


@query("op10_ngram_join")
def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class and its number of links (five words, similarity 0.8)."""
    return banding.link(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_copies", "class_key")


@query("op7_quality_votes")
def quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, the base rules, and the verdict of the weighted votes."""
    rated = stored(votes.voted(votes.counted(documents(spark, sf_dir).select("doc_id", "text")).drop("text")), "votes")
    return votes.judged(rated, votes.fit(rated)).select("doc_id", *votes.COUNTS, "base_failed", "kept", "quality")


def _lines_sql(least: int) -> str:
    """Windows as in ``winnow``, over all lines: running word counts give where each window ends or starts."""
    return rf"""WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
cut AS (SELECT r, i, line, trim(line, E' 	
') AS s FROM raw),
l AS (SELECT r, i, s, row_number() OVER w AS k, sum(len(regexp_split_to_array(s, '[ 	
]+'))) OVER w AS upto,
    len(regexp_split_to_array(s, '[ 	
]+')) AS n FROM cut WHERE s <> '' WINDOW w AS (PARTITION BY r ORDER BY i)),
win AS (SELECT a.r, a.k AS f, min(b.k) AS t FROM l a JOIN l b ON a.r = b.r AND b.k >= a.k AND b.k < a.k + {least}
      AND b.upto - a.upto + a.n >= {least} GROUP BY ALL
    UNION SELECT b.r, max(a.k), b.k FROM l a JOIN l b ON a.r = b.r AND b.k >= a.k AND b.k < a.k + {least}
      AND b.upto - a.upto + a.n >= {least} GROUP BY b.r, b.k),
told AS (SELECT win.r, f, t, string_agg(s, chr(10) ORDER BY k) AS body, min(i) AS first, max(i) AS last
    FROM win JOIN l ON l.r = win.r AND k BETWEEN f AND t GROUP BY ALL),
ranked AS (SELECT *, first_value(r) OVER w AS r1, first_value(last) OVER w AS last1 FROM told WINDOW w AS (PARTITION BY body ORDER BY r, first)),
gone AS (SELECT DISTINCT r, unnest(range(first, last + 1)) AS i FROM ranked WHERE r <> r1 OR first > last1),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS text FROM raw ANTI JOIN gone USING (r, i) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(n, 0)::INT AS n_removed
FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)"""


@query("op4_line_winnowing", _lines_sql(winnow.LEAST_WORDS))
def line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeated runs of lines of 50 words or more."""
    return winnow.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


@query("op2_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: the base spans, and those that the trees add."""
    found = stored(pii.candidates(documents(spark, sf_dir).select("doc_id", "text")).drop("text"), "candidates")
    marked = pii.select(found, pii.fit(found))
    base = F.filter("spans", lambda s: s["base"])
    return marked.withColumn("_base", base).select(
        "doc_id", *[count_of("_base", k) for k in pii.KINDS], F.sha2(spans_text(F.col("_base")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"))


@query("op3_quotation_links")
def quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in reply order, without quotes."""
    return quotes.link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op6_quality_bayes")
def quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: its text's evidence, its source as host, its language as path."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return bayes.classify(documents(spark, sf_dir), labels, F.col("source"), F.concat_ws("/", "source", "lang"))


MERKLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, lang, n_chars, list_transform([doc_id::VARCHAR, source, lang], lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')) AS a,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS b, coalesce({crc_sql("doc_id::VARCHAR")} % 7 = 0, false) AS hit FROM documents, crc_table),
leaf AS (SELECT doc_id, lang, sha256(array_to_string(a, '') || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || b) AS h,
    sha256(array_to_string(a, '') || coalesce(length((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || b) AS changed FROM d),
placed AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaf),
nodes AS (SELECT g, 0 AS lvl, i, n, h FROM placed
    UNION ALL SELECT g, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, lvl, i // 2, n),
tops AS (SELECT 0 AS lvl, g AS i, (SELECT count(DISTINCT g) FROM placed) AS n, h FROM nodes WHERE n = 1
    UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 2, n),
steps AS (SELECT g, i AS leaf_i, lvl, 0 AS tier, i, n FROM (SELECT p.g, p.i, l.lvl, l.n FROM placed p JOIN (SELECT DISTINCT g, lvl, n FROM nodes WHERE n > 1) l USING (g))),
met AS (SELECT s.g, s.leaf_i, 0 AS tier, s.lvl, (s.leaf_i >> s.lvl) & 1 AS slot, coalesce(o.h, '') AS h FROM steps s
      LEFT JOIN nodes o ON o.g = s.g AND o.lvl = s.lvl AND o.i = xor(s.leaf_i >> s.lvl, 1)
    UNION ALL SELECT p.g, p.i, 1, l.lvl, (p.g >> l.lvl) & 1, coalesce(o.h, '') FROM placed p, (SELECT DISTINCT lvl FROM tops WHERE n > 1) l
      LEFT JOIN tops o ON o.lvl = l.lvl AND o.i = xor(p.g >> l.lvl, 1)),
proof AS (SELECT g, leaf_i AS i, string_agg(h, '' ORDER BY tier, lvl) AS path, list(slot || h ORDER BY tier, lvl) AS ups FROM met GROUP BY ALL)
SELECT doc_id, p.h AS leaf, sub.h AS subroot, top.h AS root, sha256(coalesce(path, '')) AS proof_sha256,
  list_reduce(coalesce(ups, []), lambda c, s: sha256(CASE WHEN s[1] = '1' THEN s[2:] || c ELSE c || s[2:] END), changed) AS folded_root,
  folded_root = root AS verified
FROM placed p LEFT JOIN proof USING (g, i) JOIN nodes sub ON sub.g = p.g AND sub.n = 1, (SELECT h FROM tops WHERE n = 1) top"""


@query("op12_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and whether tampered rows are found out by their proofs."""
    docs = documents(spark, sf_dir)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    raised = F.col("n_chars").cast("decimal(20,0)") + hit.cast("int")
    changed = merkle.leaf_of(*[raised.cast("string") if f == "n_chars" else F.col(f) for f in merkle.FIELDS])
    made = merkle.manifest(docs, carry={"changed": changed})
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2("path", 256).alias("proof_sha256"),
                       F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults that the CRC-32 of ``conv_id:turn`` decides; a null is one space."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    hit = (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("hit")
    read = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), hit).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return read.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       copies.alias("copy")).drop("copy")


def _repair_sql() -> str:
    """The dynamic programme row by row: costs to go in four columns, then a walk that takes the least letter."""
    ahead = "CASE WHEN s IN (1, 2, 4) THEN 3 ELSE 4 END"
    go = "CASE cls WHEN 's' THEN CASE WHEN s = 1 THEN 2 END WHEN 'u' THEN CASE WHEN s <> 3 THEN 3 END WHEN 'a' THEN CASE WHEN s = 3 THEN 4 END END"
    keep = {1: "CASE cls WHEN 's' THEN v[2] WHEN 'u' THEN v[3] END", 2: "CASE cls WHEN 'u' THEN v[3] END",
            3: "CASE cls WHEN 'a' THEN v[4] END", 4: "CASE cls WHEN 'u' THEN v[3] END"}
    base = ", ".join(f"CASE WHEN gone THEN 4 + v[{s}] ELSE least(4 + v[{s}], more + {keep[s]}, 3 + more + v[{4 if s == 3 else 3}]) END AS b{s}" for s in keep)
    return rf"""
WITH RECURSIVE {CRC_TABLE},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS hit FROM conversations, crc_table),
hurt AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM src WHERE hit <> 0),
keyed AS (SELECT *, md5(octet_length(encode(role)) || ':' || role || text) AS same, rtrim(text, E' 	

') AS bare FROM hurt),
ordered AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, *,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, same, copy) AS p,
    count(*) OVER (PARTITION BY conv_id) AS n FROM keyed),
lines AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN min(p) OVER (PARTITION BY c, same) < p THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault, left(role, 1) AS cls FROM ordered),
r AS MATERIALIZED (SELECT c, p, n, cls, role, text, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM lines),
costs AS (SELECT c, n + 1 AS p, [0, 6, 3, 0] AS w FROM (SELECT DISTINCT c, n FROM r)
    UNION ALL SELECT c, p, [least(b1, 3 + b3, 6 + b4), least(b2, 3 + b3, 6 + b4), least(b3, 3 + b4), least(b4, 3 + b3)] FROM (
      SELECT r.c, r.p, {base} FROM (SELECT c, p, w AS v FROM costs) k JOIN r ON r.c = k.c AND r.p = k.p - 1)),
walk AS (SELECT c, 1::BIGINT AS p, 1 AS s, '' AS audit, ''::VARCHAR AS body, 0 AS held FROM (SELECT DISTINCT c FROM r)
    UNION ALL SELECT c, CASE WHEN e = 'I' THEN p ELSE p + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN go ELSE ahead END, audit || e,
      CASE WHEN e = 'D' THEN body ELSE body || CASE WHEN held > 0 THEN chr(10) ELSE '' END
        || CASE WHEN e = 'K' THEN role WHEN ahead = 3 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END END,
      held + (e <> 'D')::INT FROM (
      SELECT *, CASE WHEN p <= n AND now[s] = 4 + v[s] THEN 'D' WHEN now[s] = 3 + now[ahead] THEN 'I'
          WHEN NOT gone AND go IS NOT NULL AND now[s] = more + v[go] THEN 'K' ELSE 'R' END AS e FROM (
        SELECT walk.*, k.w AS now, x.w AS v, r.n, r.gone, r.more, r.role, r.text, {ahead} AS ahead, {go} AS go
        FROM walk JOIN costs k ON k.c = walk.c AND k.p = walk.p LEFT JOIN r ON r.c = walk.c AND r.p = walk.p
        LEFT JOIN costs x ON x.c = walk.c AND x.p = walk.p + 1)
      WHERE n IS NOT NULL OR now[s] > 0)),
ended AS (SELECT c, arg_max(audit, length(audit)) AS audit, arg_max(body, length(audit)) AS body FROM walk GROUP BY c),
pairs AS (SELECT c, cls || lead(cls) OVER (PARTITION BY c ORDER BY p) AS two FROM r),
bad AS (SELECT c, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY c),
told AS (SELECT conv_id, c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM lines GROUP BY ALL)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(w[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended ON ended.c = told.c LEFT JOIN bad ON bad.c = told.c LEFT JOIN costs ON costs.c = told.c AND costs.p = 1"""


@query("op13_turn_repair", _repair_sql())
def turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage: their faults, the cheapest repair, and a digest of what it gives."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    audit, _ = turns.repair(damaged(rows))
    nothing = [F.lit(0).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = rows.select("conv_id", *nothing, F.lit("").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256"))
    return audit.unionByName(empty).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in audit.columns[1:-1]], F.coalesce(
        F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op11_setsketch", r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, r, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: hash(array_to_string(w[i:i + 4], ' '))))) AS s
    FROM d WHERE len(w) > 0),
variants AS (SELECT s, min(doc_id) AS least, row_number() OVER () AS v FROM sets GROUP BY s),
flat AS (SELECT v, unnest(s) AS x, len(s) AS n FROM variants),
links AS (SELECT a.v AS a, b.v AS b FROM flat a JOIN flat b ON a.x = b.x AND a.v < b.v AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.v, b.v, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT v, v AS u FROM variants UNION SELECT reach.v, edges.b FROM reach JOIN edges ON edges.a = reach.u),
classes AS (SELECT reach.v, min(least) AS component_id FROM reach JOIN variants ON variants.v = reach.u GROUP BY reach.v)
SELECT d.doc_id, coalesce(len(sets.s), 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
  coalesce(component_id, d.doc_id) IS NOT DISTINCT FROM d.doc_id AS kept
FROM d LEFT JOIN sets USING (r) LEFT JOIN variants USING (s) LEFT JOIN classes USING (v)""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of its near duplicates (five words, similarity 0.85)."""
    return setsketch.link(documents(spark, sf_dir).select("doc_id", "text")).drop("text_key")
