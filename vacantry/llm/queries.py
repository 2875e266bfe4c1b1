"""Registered queries of the operators; each runs over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantry.llm import (archive, collocation, decontaminate, gam, hyper_minhash, langid, merkle, packing, pii,
                          repeats, rules, shingle_join, token_counts)
from vacantry.llm.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of base test and learned rules for every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = rules.train_rules(docs, labels)
    return (rules.judge(docs.select("doc_id", "text"), learned, drop=("text",))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "kept", "rule"))


@query
def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and the smallest id it is linked with."""
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), drop=("text",))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base matches and what the span classifier adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(docs, pii.train_spans(docs))


def byte_vocabulary() -> dict[str, str]:
    """Path and split pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, Scratch(spark, "op7"), **byte_vocabulary())


@query
def op1_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels outside the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = gam.held_out(5, 0)
    model = gam.train(docs, labels, where=~held)
    out = gam.scored(docs.select("doc_id", "text"), model, drop=("text",))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    held = gam.held_out(3, 1)
    out = langid.predicted(docs, langid.train(docs, where=~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op3_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written to a content-addressed archive and read back."""
    records = archive.read(archive.write(table(spark, sf_dir, "pages"), Scratch(spark, "op3")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op3_archive"] = """
    WITH r AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
    s AS (SELECT page_id, octet_length(encode(p)) AS n, sha1(encode(p)) AS d,
                 max(page_id) OVER (PARTITION BY p) AS top FROM r)
    SELECT page_id, n AS payload_bytes, d AS payload_digest,
           CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
    FROM s"""


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count and best score of every document."""
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that strings of 400 bytes repeated anywhere cover, removed from every document."""
    return repeats.without_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof digest and root of every document, and the root that tampered texts of a fifth of them lead to."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                      merkle.leaf_digest(text=merkle.folded_case()))
    out = merkle.manifest(docs, Scratch(spark, "op12"), tampered)
    out = out.withColumn("folded_root", merkle.fold("altered", "proof"))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("proof").alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return collocation.collocations(table(spark, sf_dir, "documents").select("text", "lang"), Scratch(spark, "op11"))


ORACLES["op11_collocations"] = r"""
    WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
               FROM documents),
    p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    s AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
    i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS j FROM s),
    g AS (SELECT lang, w[j] AS x, w[j + 1] AS y, w[j + 2] AS z FROM i),
    f1 AS (SELECT lang, x, count(*) AS f FROM g GROUP BY ALL),
    f2 AS (SELECT lang, x, y, count(*) AS f FROM g WHERE y IS NOT NULL GROUP BY ALL),
    f3 AS (SELECT lang, x, y, z, count(*) AS f FROM g WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY ALL),
    cuts AS (
        SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
        FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f1 r ON r.lang = c.lang AND r.x = c.y
        WHERE c.f >= 10 AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = c.lang AND t.x = c.x AND t.y = c.y
                                        AND 100 * t.f >= 50 * c.f)
          AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = c.lang AND t.y = c.x AND t.z = c.y AND 100 * t.f >= 50 * c.f)
        UNION ALL
        SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 1, l.f, r.f
        FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f2 r ON r.lang = c.lang AND r.x = c.y AND r.y = c.z
        UNION ALL
        SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 2, l.f, r.f
        FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.x = c.x AND l.y = c.y JOIN f1 r ON r.lang = c.lang AND r.x = c.z),
    scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM best JOIN n USING (lang)
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


@query
def op13_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set, the smallest id it is linked with, and whether it is the one kept."""
    return hyper_minhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


def _merkle_sql(levels: int = 6, upper: int = 4) -> str:
    """The manifest with its levels written out: up to 16**levels documents a source and 16**upper sources."""
    def text(name):
        return f"coalesce(octet_length(encode({name}::VARCHAR))::VARCHAR || ':' || {name}::VARCHAR, '-')"

    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(text(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bits = "list_transform(range(0, 8 * length(s)), lambda j: ((ascii(s[j // 8 + 1]) >> (j % 8)) & 1)::BIGINT)"
    crc = (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), "
           "lambda c, b: xor(c >> 1, CASE WHEN (c & 1) <> b THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT)")

    def tree(name, tables, group):
        key = "source, " if group else ""
        part = f"PARTITION BY {key}i // 16 ORDER BY i ROWS BETWEEN"
        for k in range(tables):
            yield (f"{name}{k + 1} AS (SELECT {key}i // 16 AS i, (any_value(m) + 15) // 16 AS m, CASE WHEN any_value(m) > 1 THEN "
                   f"sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY {key}i // 16)")
            yield (f"{name}p{k} AS (SELECT {key}i, m, coalesce(string_agg(h, '') OVER ({part} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                   f"coalesce(string_agg(h, '') OVER ({part} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")

    steps = [(f"np{k}", f"np{k}.source IS NOT DISTINCT FROM d.source AND np{k}.i = d.i // {16 ** k}") for k in range(levels)]
    steps += [(f"sp{k}", f"sp{k}.i = s0.i // {16 ** k}") for k in range(upper)]
    folds, proof = ["coalesce(other, leaf) AS f0"], []
    for k, (p, _) in enumerate(steps):
        folds.append(f"CASE WHEN {p}.m > 1 THEN sha256({p}.l || f{k} || {p}.r) ELSE f{k} END AS f{k + 1}")
        proof.append(f"CASE WHEN {p}.m > 1 THEN {p}.l || {p}.r ELSE '' END")
    joins = "JOIN s0 ON s0.source IS NOT DISTINCT FROM d.source " + " ".join(f"JOIN {p} ON {on}" for p, on in steps)
    return f"""
    WITH e AS (SELECT doc_id, source, sha256({head} || {text('text')}) AS leaf, doc_id::VARCHAR AS s,
                      sha256({head} || {text(folded)}) AS altered FROM documents),
    d AS (SELECT doc_id, source, leaf, CASE WHEN {crc} % 5 = 0 THEN altered END AS other,
                 row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM e),
    n0 AS (SELECT source, i, m, leaf AS h FROM d), {', '.join(tree('n', levels, True))},
    s0 AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS m, h FROM n{levels}),
    {', '.join(tree('s', upper, False))},
    f AS (SELECT doc_id, leaf, s0.h AS subroot, (SELECT h FROM s{upper}) AS root, {' || '.join(proof)} AS proof, {', '.join(folds)} FROM d {joins})
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f{len(steps)} AS folded_root, f{len(steps)} = root AS verified FROM f"""


ORACLES["op12_merkle"] = _merkle_sql()
