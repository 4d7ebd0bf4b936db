"""The registered query of each operator, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import chat_format, conversation_repair, fingerprints, license_scan, media, mixing, ngram_join, periodic_runs, rasters, sentencepiece_codec, sharding, sql, substring_dedup, token_counts, toxicity
from factloom.llm.common import WORD, documents, fresh, shared_folder, text_of


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Tokens beyond which a document is too long for one training window.
TOKEN_LIMIT = 512


#: The search by block tables: bits within which fingerprints are near, and blocks (28 tables with keys of 32 bits).
NEAR_BITS, NEAR_BLOCKS = 6, 8


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and of its edited text; for every fiftieth id which documents are within NEAR_BITS bits."""
    found = fingerprints.with_neighbours(documents(spark, sf_dir))
    return fingerprints.count_within(found, F.col("doc_id") % 50 == 0, NEAR_BITS, NEAR_BLOCKS)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a model fitted on the rows that are not held out."""
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.train(docs, labels(spark, sf_dir)), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 85 per cent of its 4-word shingles."""
    return ngram_join.link_components(documents(spark, sf_dir), shingle=4, percent=85)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    mixed = mixing.mix(documents(spark, sf_dir), cap=3)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that is cut out of a document because an earlier place has it, with the document that keeps it.

    A document that nothing is cut out of has one row with null places; left_sha256 is the digest of what is left of the text.
    """
    left = substring_dedup.dedupe(documents(spark, sf_dir).select("doc_id", "text"))
    rows = left.select("doc_id", F.sha2("text", 256).alias("left_sha256"), F.char_length("text").cast("long").alias("left_chars"), F.inline_outer("cut_spans"))
    return rows.select("doc_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.col("first").alias("kept_in_doc_id"), "left_chars", "left_sha256")


def op6_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every image, and for an edited copy of every fiftieth image the classes that it is a copy of.

    No table holds images, so each row of embeddings is drawn as one: near vectors make near images. Rows of
    kind member say which class (by its representative's vec_id) an image is in, rows of kind copy which
    class an edited image was found in, with the votes and the motion that carries the one onto the other.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    images = rasters.with_images(vectors, "embedding", "vec_id")
    asked = rasters.with_images(vectors.where(F.col("vec_id") % 50 == 0), "embedding", "vec_id", edit=True)
    copies, members = media.find_copies(images, asked, "media", "vec_id")
    copies = copies.select(F.lit("copy").alias("kind"), F.col("query_id").alias("vec_id"), F.col("class_id").alias("class_vec_id"), "votes", "turn", "scale", "dx", "dy")
    return members.select(F.lit("member").alias("kind"), "vec_id", F.col("class_id").alias("class_vec_id")).unionByName(copies, allowMissingColumns=True)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.summary(license_scan.scan(documents(spark, sf_dir)))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, from a cache that is empty when the query starts."""
    counted = token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), shared_folder(spark, "token-counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


#: Sharding: the wanted size of a file, the size up to which a shard is small, and arrivals in each of two waves, at least.
SHARD_BYTES, SMALL_BYTES, WAVES = 32 << 20, 1 << 20, (48, 16)
#: Bytes of input in an arrival, about and at most: larger tables make more arrivals.
ARRIVAL_BYTES = 8 << 20


def arrivals_of(size: int) -> tuple[int, int]:
    """The arrivals in each wave for so many bytes of input."""
    n = max(sum(WAVES), -(-size // ARRIVAL_BYTES))
    first = n * WAVES[0] // sum(WAVES)
    return first, n - first


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document after two waves of arrivals, each compacted, with its text's digest read back."""
    docs = documents(spark, sf_dir)
    store = sharding.ShardStore(spark, shared_folder(spark, "shards"), SHARD_BYTES, SMALL_BYTES)
    size = docs.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size")).first()[0] or 0
    first, second = arrivals_of(size)
    arrival, into = fresh("arrival_number", *docs.columns), fresh("located", *docs.columns)
    rows = docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id", "text"), F.lit(first + second)))
    # an arrival is one small file, whatever the number of tasks
    store.append(rows.where(F.col(arrival) < first).repartition(arrival), arrival)
    store.compact(docs.schema)
    store.append(rows.where(F.col(arrival) >= first).repartition(arrival), arrival)
    store.compact(docs.schema)
    at = F.col(into)
    return store.located(docs.schema, into).select("doc_id", at["name"].alias("shard"), at["tier"].alias("tier"), at["version"].alias("version"), at["rows"].alias("shard_rows"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    coded = sentencepiece_codec.round_trip(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


#: A conversation whose texts are made of the template's own control strings.
AWKWARD_ID, AWKWARD_TEXT = -1, "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one training text: its turns and the text under the loss mask, read back from the output."""
    rows = conversations(spark, sf_dir).select("conv_id", "turn", "role", "text")
    awkward = spark.createDataFrame([(AWKWARD_ID, k, role, AWKWARD_TEXT) for k, role in enumerate(("user", "assistant"))], rows.schema)
    back = chat_format.read_back(chat_format.format_conversations(rows.unionByName(awkward)))
    said = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def looped(docs: DataFrame) -> DataFrame:
    """docs, about every tenth of which repeats itself from some word on; the ids alone say which, where and how often.

    Rows without an id and without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
        made = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int"))), " ")
        return F.when(n > 0, made)

    # within an array of one element the words are split once and named
    made = F.transform(F.array(F.regexp_extract_all(text_of(), F.lit(f"({WORD})"), F.lit(1))), loop)[0]
    return docs.withColumn("text", F.when(h % 10 == 0, F.coalesce(made, F.col("text"))).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of periodic words of every document, some of which were made to loop, and what is left without repeats."""
    found = periodic_runs.collapse(looped(documents(spark, sf_dir).select("doc_id", "text")), keep=("doc_id",))
    longest = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    rows = found.select("doc_id", "runs", "collapsed", longest.alias("longest"), F.array_join(lines, "").alias("lines"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        "longest.length",
        (-F.col("longest.period")).alias("period"),
        F.expr("(1000 * longest.length) div -longest.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations, some dropped, emptied, without their sentence ends, doubled or said by the user; their keys say which."""
    one_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(one_blank("conv_id"), F.lit(":"), one_blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", one_blank("role").alias("role"), one_blank("text").alias("text"), way.alias("way")).where("way <> 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("way") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("once")).drop("once")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of every conversation after some damage, and the cheapest edits that mend its structure."""
    turns = conversations(spark, sf_dir)
    audits, rows = conversation_repair.repair(damaged(turns))
    found = conversation_repair.digests(rows).withColumnRenamed("sha256", "repaired_sha256")
    own = turns.select("conv_id").distinct().withColumnRenamed("conv_id", "own")
    every = own.join(audits, F.col("own").eqNullSafe(audits["conv_id"]), "left").drop("conv_id")
    every = every.join(found, F.col("own").eqNullSafe(found["conv_id"]), "left")
    counts = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(F.col("own").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: Names to functions of (spark, sf_dir).
QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_mix_sources": op4_mix_sources,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_media_copies": op6_media_copies,
    "op7_license_scan": op7_license_scan,
    "op8_sharding": op8_sharding,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_token_counts": op10_token_counts,
    "op11_chat_format": op11_chat_format,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

#: Names to DuckDB SQL, where SQL can express the query.
ORACLES: dict[str, str] = {
    "op3_ngram_join": sql.JOIN_SQL,
    "op4_mix_sources": mixing.MIX_SQL,
    "op7_license_scan": license_scan.scan_sql(),
    "op11_chat_format": sql.CHAT_SQL,
    "op13_conversation_repair": sql.REPAIR_SQL,
}
