"""Registered query: uploads that arrive in waves."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tallyfolio.plans import sql
from tallyfolio.plans.inference_queries import _SQL_FEATURES, _sql_aspects, sql_score
from tallyfolio.plans.registry import query
from tallyfolio.plans.samples import documents, jobs, with_request
from tallyfolio.plans.store_queries import new_results_table
from tallyfolio.plans.stubs import stub_models
from tallyfolio.slices import all_slices
from tallyfolio.sources.files import file_system
from tallyfolio.streaming.intake import Arrivals, score_stream
from tallyfolio.workspace import folders_in, new_folder, remove, scratch

WAVES = 3


def _store_wave(rows, folder: str) -> None:
    """Every row as a file ``folder/<request>/<wave>/<name>``."""
    def store(batches):
        (system, base), made = file_system(folder), set()
        for batch in all_slices(batches):
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist()):
                place = f"{base}/{path.rsplit('/', 1)[0]}"
                if place not in made:
                    system.create_dir(place, recursive=True)
                    made.add(place)
                with system.open_output_stream(f"{base}/{path}") as file:
                    file.write(text.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rows.mapInArrow(store, "n long").agg(F.sum("n")).first()


def _remove_landed(spark, folder: str) -> None:
    """Remove the files of all requests in tasks, as they were made."""
    def drop(batches):
        system, base = file_system(folder)
        for batch in batches:
            for name in batch["name"].to_pylist():
                system.delete_dir_contents(f"{base}/{name}", missing_dir_ok=True)
            yield batch

    names = spark.createDataFrame([(name,) for name in folders_in(spark, folder)], "name string")
    names.repartition(spark.sparkContext.defaultParallelism).mapInArrow(drop, "name string").count()
    remove(spark, folder)


@query("stream_arrivals", f"""WITH files AS (
    SELECT {sql.REQUEST} AS request_id, doc_id // {sql.N_JOBS} // {WAVES} AS slot, doc_id // {sql.N_JOBS} % {WAVES} AS wave,
      {sql.clean("text")} AS content FROM documents),
  features AS ({_SQL_FEATURES}),
  named AS (SELECT *, wave = max(wave) OVER (PARTITION BY request_id, slot) AS is_last, '.cv' || slot || '.txt' AS name FROM files),
  aspects AS (SELECT *, CASE WHEN is_last THEN {_sql_aspects("content")} END AS key_aspects FROM named),
  scored AS (SELECT a.*, {sql_score("coalesce(a.key_aspects, '')", "f.job_features")} AS reply FROM aspects a JOIN features f USING (request_id))
SELECT 'stream-' || wave AS load_id, name AS resume_name, content AS resume_content,
  CASE WHEN is_last THEN {sql.clean("coalesce(key_aspects, '')")} END AS resume_key_aspect,
  CASE WHEN is_last THEN CAST(coalesce({sql.parse_score("reply")}, '0') AS INTEGER) END AS score
FROM scored""")
def stream_arrivals(spark, sf_dir):
    """All documents as hidden files that arrive in three waves: a later file of a name takes the score over from an earlier load."""
    slot = with_request(spark, sf_dir, documents(spark, sf_dir))
    count = jobs(spark, sf_dir).agg(F.count("*")).scalar()
    number = F.floor(F.col("doc_id") / count)
    files = slot.select("text", (number % WAVES).alias("wave"), F.concat(
        F.lit("r"), "request_id", F.lit("/"), number % WAVES, F.lit("/.cv"), F.floor(number / WAVES), F.lit(".txt")).alias("path"))
    asked = jobs(spark, sf_dir).select(F.concat(F.lit("r"), "request_id").alias("request_id"), "jd_text")
    landing, work, store = new_folder(spark, "landing"), new_folder(spark, "stream"), new_results_table(spark)
    for wave in range(WAVES):
        with scratch(spark):
            _store_wave(files.filter(F.col("wave") == wave), landing)
        arrivals = Arrivals(spark, [landing], f"{work}/arrivals")
        score_stream(arrivals, asked, stub_models(), store, f"{work}/checkpoint").awaitTermination()
    _remove_landed(spark, landing)      # the table holds all that is returned
    remove(spark, work)
    return store.read().select("load_id", "resume_name", "resume_content", "resume_key_aspect", "score")
