"""The registered queries of the training-data operators and their DuckDB SQL.

Each query applies its operator, with production parameters, to the whole of its
table and derives the columns of its contract from the operator's result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, chat, cover_tree, document_fingerprint, html_text, merkle_manifest, mixing, pii, quality_knn, quality_rules, simhash, suffix_dedup, token_alignment
from fleetlens.llm.common import shared_folder, table, written

TOKENIZER = "byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every byte covered by a 400-byte string that also starts anywhere else in the documents."""
    out = suffix_dedup.deduplicated(_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole document by its labelled neighbours in a latent semantic space; labels
    of held-out documents (crc32 of the id mod 4 = 2) are never learned from."""
    docs = _documents(spark, sf_dir)
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    learn = table(spark, sf_dir, "labels").filter(~held)
    scored, name = quality_knn.score(docs, quality_knn.fit(docs, learn))
    return scored.select("doc_id", held.alias("held_out"), F.col(name).alias("score"),
                         (F.col(name) >= quality_knn.THRESHOLD).cast("int").alias("predicted"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract the main text of every whole page."""
    shared_folder(spark)
    out, name = html_text.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "html")
    return out.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, and one of control strings only, into budgeted windows; digests are read back from those."""
    control = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT -1L AS conv_id, * FROM VALUES (0L, 'user', '{control}'), (1L, 'assistant', '{control}') AS t(turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = chat.conversations(chat.windows(turns))
    return out.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                      F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link all embeddings of a label at a cosine of 0.93 or more and group them."""
    shared_folder(spark)
    out = cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every whole document by the base rules and a decision list learned from labelled statistics."""
    docs = _documents(spark, sf_dir)
    out, c = quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    return out.select("doc_id", *[F.col(c[n]).alias(n) for n in names])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find personal data in every whole document."""
    out, c = pii.detect(_documents(spark, sf_dir))
    return out.select("doc_id", *[F.col(c[f"n_{k}"]).alias(f"n_{k}") for k in pii.BASE_KINDS],
                      F.sha2(c["base_spans"], 256).alias("base_sha256"), F.col(c["spans"]).alias("spans"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to their sources' targets."""
    shared_folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = written(mixing.measured(docs, keep=[]).drop("_row"), "mix-rows")
    out = mixing.mixed(rows, written(mixing.budgets(rows), "mix-plan"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
                      (F.col("copies") * F.col("_size")).alias("taken"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         coalesce(greatest(0.05::DOUBLE, 1 - 4 * ((length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / nullif(length(text), 0))), 1.0::DOUBLE) AS weight
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE) / weight AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS n, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, ((SELECT 1.5::DOUBLE * sum(source_size) FROM s) - coalesce(sum(cap) OVER b, 0))
                / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, row_number() OVER (ORDER BY cap / w, n) AS place FROM l),
f AS (SELECT level, place FROM c WHERE cap > level * w ORDER BY place LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN place < coalesce((SELECT place FROM f), 9223372036854775807) THEN cap ELSE (SELECT level FROM f) * w END AS target
      FROM c),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, target - epochs * source_size AS rest,
             sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every whole document and group those linked at two differing bits or fewer."""
    out = simhash.near_duplicates(_documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole document with a public byte-level vocabulary, and decode the ids."""
    ranks = bpe.read_ranks(public_tokenizers.path(TOKENIZER))
    ids, name = bpe.encoded(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    back, raw, digest = bpe.decoded(ids, ranks, name)
    return back.select("doc_id", F.size(name).cast("long").alias("n_tokens"), F.col(digest).alias("ids_sha256"),
                       F.sha2(raw, 256).alias("decoded_sha256"))


def op11_document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every whole document and an edited version, whose second half comes from the next document by descending id;
    compare the document's fingerprint with the edited version's and the next document's."""
    rows = document_fingerprint.with_following(_documents(spark, sf_dir), "doc_id", "text")
    rows = rows.withColumn("edited", document_fingerprint.edited(F.col("text"), F.col("following")))
    rows = document_fingerprint.fingerprinted(rows, {"text": "fingerprint", "edited": "edited_fingerprint", "following": "next_fingerprint"})
    rows = document_fingerprint.with_likeness(rows, {"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "next_fingerprint")})
    return rows.select(F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle manifest of all documents by language, with every document's proof; the check of a proof starts from the changed
    document where 7 divides the checksum of its id."""
    shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle_manifest.leaf(*[more.get(f, F.col(f)) for f in fields]))
    out = merkle_manifest.manifest(docs, fields, "doc_id", "lang", carry={"changed": tampered})
    out = out.withColumn("folded_root", merkle_manifest.folded(F.coalesce("changed", "leaf"), F.col("path")))
    return out.select(F.col("id").alias("doc_id"), merkle_manifest.hexed(F.col("leaf")).alias("leaf"), "subroot", "root",
                      F.sha2(merkle_manifest.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(n_chars: str) -> str:
    values = {"doc_id": "doc_id", "source": "source", "lang": "lang", "n_chars": n_chars, "text": "text"}
    return "sha256(" + " || ".join(f"coalesce(strlen(({v})::VARCHAR)::VARCHAR || ':' || ({v})::VARCHAR, '-')" for v in values.values()) + ")"


OP12_SQL = f"""
WITH RECURSIVE
bits(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('n_chars::HUGEINT + 1')} AS changed,
             coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, [unicode(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
                                      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 7 = 0, false) AS tampered
      FROM documents, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
tree(lang, lvl, pos, digest, n) AS (
  SELECT lang, 0, pos, leaf, n FROM p
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
subroots AS (SELECT lang, lvl, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top(lvl, pos, digest, n) AS (
  SELECT 0, pos, digest, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n),
nodes AS (SELECT 'leaf' AS part, lang, lvl, pos, digest FROM tree UNION ALL SELECT 'top', NULL, lvl, pos, digest FROM top),
walk(doc_id, lang, leaf, part, lvl, pos, now, proof) AS (
  SELECT doc_id, lang, leaf, 'leaf', 0, pos, CASE WHEN tampered THEN changed ELSE leaf END, '' FROM p
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, CASE WHEN s.pos IS NULL THEN w.part ELSE 'top' END,
         CASE WHEN s.pos IS NULL THEN w.lvl + 1 ELSE 0 END, CASE WHEN s.pos IS NULL THEN w.pos // 2 ELSE s.pos END,
         CASE WHEN s.pos IS NOT NULL THEN w.now WHEN o.digest IS NULL THEN sha256(w.now) WHEN w.pos % 2 = 1 THEN sha256(o.digest || w.now) ELSE sha256(w.now || o.digest) END,
         CASE WHEN s.pos IS NOT NULL OR o.digest IS NULL THEN w.proof ELSE w.proof || o.digest END
  FROM walk w
  LEFT JOIN subroots s ON w.part = 'leaf' AND s.lang IS NOT DISTINCT FROM w.lang AND s.lvl = w.lvl
  LEFT JOIN nodes o ON o.part = w.part AND o.lvl = w.lvl AND o.pos = xor(w.pos, 1) AND (w.part = 'top' OR o.lang IS NOT DISTINCT FROM w.lang)
  WHERE w.part = 'leaf' OR w.lvl < (SELECT max(lvl) FROM top))
SELECT w.doc_id, w.leaf, s.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.now AS folded_root, w.now = r.digest AS verified
FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang
JOIN (SELECT lvl, digest FROM top WHERE n = 1) r ON w.part = 'top' AND w.lvl = r.lvl
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align the tokens of two public vocabularies over every whole document; pair counts are corpus-wide."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        rows, c = token_alignment.aligned(_documents(spark, sf_dir), a.read(), b.read())
    groups = F.when(F.col(c["n_a"]) > 0, F.sha2(c["groups"], 256)).otherwise("")
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *[F.col(c[n]).alias(n) for n in numbers],
                               groups.alias("groups_sha256"), F.col(c["pairs"]).alias("pairs"), F.col(c["pair_n"]).alias("pair_n")), "align-rows")
    counts = token_alignment.corpus_counts(rows, "row")
    out = rows.drop("pairs", "pair_n").join(counts, "row", "left")
    return out.select("doc_id", *numbers, *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_best", "count_sum")], "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_quality_knn, op3_html_text, op4_chat_windows, op5_cover_tree, op6_quality_rules, op7_pii, op8_mixing, op9_simhash, op10_bpe, op11_document_fingerprint, op12_merkle_manifest, op13_token_alignment)}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op8_mixing": OP8_SQL, "op12_merkle_manifest": OP12_SQL}
