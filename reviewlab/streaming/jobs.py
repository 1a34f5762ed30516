"""Structured Streaming jobs: reviews and questions arriving as files.

Each micro-batch is joined to a static, already written table (the model
weights, the chunk vectors) inside ``foreachBatch``; every epoch writes
its own output folder in overwrite mode, so a replayed epoch after a
failure replaces its earlier output instead of duplicating it.  Progress
lives in the checkpoint folder below the cluster's checkpoint root.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import bayes as NB
from ..operators import retrieval as RT
from ..operators import text as TXT
from ..session import scratch_path, written


def _run(stream: DataFrame, handle, workdir: str) -> None:
    q = (stream.writeStream.foreachBatch(handle)
         .option("checkpointLocation", f"{workdir}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def land_files(df: DataFrame, path: str) -> None:
    """Write rows as parquet files, one per partition: the arriving input."""
    df.write.mode("overwrite").parquet(path)


def _source(spark: SparkSession, schema: str, path: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def stream_score(spark: SparkSession, reviews: DataFrame | None, model: DataFrame, files_per_batch: int | None = None,
                 workdir: str | None = None, source_path: str | None = None, stems: DataFrame | None = None) -> DataFrame:
    """Score arriving reviews with a trained Naive Bayes table.

    The stream reads parquet files (doc_id, label, text) from
    ``source_path``; when none is given, ``reviews`` is landed as files
    first.  model: (token, loglikelihood, logprior); stems: a written table
    (word, stem), so that each epoch stems new words only.  Returns the sink:
    (doc_id, label, score, prediction), equal to the batch ``nb_predict``
    of the same rows.
    """
    workdir = workdir or scratch_path(spark, "stream_score")
    src, sink, weights_path = source_path or f"{workdir}/in", f"{workdir}/out", f"{workdir}/weights"
    if source_path is None:
        land_files(reviews.select("doc_id", "label", "text"), src)
    model.select("token", "loglikelihood", "logprior").write.mode("overwrite").parquet(weights_path)
    weights = spark.read.parquet(weights_path)
    prior = weights.agg(F.max("logprior").alias("logprior"))
    stream = _source(spark, "doc_id bigint, label int, text string", src, files_per_batch)

    def handle(batch: DataFrame, epoch: int) -> None:
        docs = batch.select("doc_id", "label", "text")
        toks = TXT.corpus_tokens(docs, "text", keep=("doc_id",), stems=stems)
        scored = NB.nb_predict(docs.select("doc_id", "label"), toks, weights, prior=prior)
        scored.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    _run(stream, handle, workdir)
    return spark.read.parquet(sink).drop("epoch")


def stream_retrieve(spark: SparkSession, questions: DataFrame | None, chunk_vectors: DataFrame, k: int = 3,
                    files_per_batch: int | None = None, workdir: str | None = None, source_path: str | None = None,
                    query_type: str = "bigint") -> DataFrame:
    """Answer arriving questions (query_id, question) with their top-k
    chunks from a static vector table (doc_id, chunk_no, embedding).
    Questions stream from ``source_path``, or are landed from ``questions``."""
    workdir = workdir or scratch_path(spark, "stream_retrieve")
    src, sink = source_path or f"{workdir}/in", f"{workdir}/out"
    q_type = questions.schema["query_id"].dataType.simpleString() if questions is not None else query_type
    if source_path is None:
        land_files(questions.select("query_id", "question"), src)
    vectors = RT.packed_chunks(chunk_vectors)  # once for all epochs
    stream = _source(spark, f"query_id {q_type}, question string", src, files_per_batch)

    def handle(batch: DataFrame, epoch: int) -> None:
        qv = RT.embed(batch, "question")
        hits = RT.top_k(qv, None, k, "query_id", ("doc_id", "chunk_no"), packed=vectors)
        hits.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    _run(stream, handle, workdir)
    return spark.read.parquet(sink).drop("epoch").select("query_id", "rank", "doc_id", "chunk_no",
                                                         F.col("score"))


REMEMBERED = "conv_id {0}, turn bigint, role string, text string, history string, n_prev bigint"


def remembering(idle_ms: int | None):
    """State function of a conversation: its lines so far and its last turn.

    Rows of a batch are taken by turn; one at or before the last turn is a replay and adds
    nothing.  Each new row comes out with the lines before it.
    """
    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        lines, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        out = []
        for turn, role, text in zip(rows["turn"], rows["role"], rows["text"]):
            if last is not None and turn <= last:
                continue
            out.append((key[0], turn, role, text, "\n".join(lines), len(lines)))
            lines.append(f"{role}: {'' if text is None else text}")
            last = turn
        if lines:
            state.update((lines, int(last)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "history", "n_prev"])
    return step


def remembered(turns: DataFrame, idle_ms: int | None = None, key_type: str = "bigint") -> DataFrame:
    """A stream of turns (conv_id, turn, role, text) with the history of their conversation, kept as keyed state.

    idle_ms: time after which an idle conversation is forgotten, for queries that run on; a timeout asks for a
    batch at any time, so a run over what is available now would not end with one.
    Rows with a null key or turn are left out.
    """
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id").applyInPandasWithState(
        remembering(idle_ms), REMEMBERED.format(key_type), "lines array<string>, last bigint", "append", timeout)


def stream_conversations(spark: SparkSession, source_path: str, workdir: str, vectors: DataFrame | None = None, k: int = 3,
                         files_per_batch: int | None = None, key_type: str = "bigint") -> DataFrame:
    """Turns that have arrived since the last run over workdir, with their conversations' history (`remembered`).

    The state lives in the checkpoint below workdir, so a later run goes on where the last one ended, and
    turns that arrive again add nothing.  Turns of a conversation must arrive in order over batches (any order within
    one).  Returns the sink: (conv_id, turn, role, text, history, n_prev), and with `vectors`
    (`retrieval.packed_chunks`) the user turns' top-k chunks too, as an array `hits`.
    """
    sink = f"{workdir}/out"
    turns = _source(spark, f"conv_id {key_type}, turn bigint, role string, text string", source_path, files_per_batch)
    known = remembered(turns, None, key_type)

    def handle(batch: DataFrame, epoch: int) -> None:
        if vectors is None:
            batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
            return
        rows = written(batch, "conversation-turns")  # the state function runs once an epoch
        asked = rows.where("role = 'user'").withColumn("q", F.concat_ws(":", "conv_id", "turn"))
        hits = RT.top_k(RT.embed(asked, "text"), None, k, "q", ("doc_id", "chunk_no"), packed=vectors)
        listed = hits.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "chunk_no", "score"))).alias("hits"))
        rows.withColumn("q", F.concat_ws(":", "conv_id", "turn")).join(listed, "q", "left").drop("q").write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    _run(known, handle, workdir)
    return spark.read.parquet(sink).drop("epoch")
