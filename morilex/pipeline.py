"""The engine as a whole: sentences in, new dictionary entries out, by batch or as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import acquire, align, context, dictionaries
from .operators.storage import hadoop_path, written
from .options import Options
from .sources import analysers

_ENTRIES = "stem string, pos_s string, cnt long"
_KATAKANA = "^[ァ-ヴー]{2,}$"


class Engine:
    """Wires reading, analysis, detection, induction and registration over one dictionary with versions.

    words: known words with their parts of speech; suffixes(suffix, pos_s, katuyou2). Listeners are told of every event
    of the log, as a table.
    """

    def __init__(self, spark: SparkSession, suffixes: DataFrame, words: dict[str, str], options: Options):
        self.spark, self.suffixes, self.words, self.options = spark, suffixes, words, options
        self.listeners: list[Callable[[DataFrame], None]] = []

    def listen(self, function: Callable[[DataFrame], None]) -> None:
        self.listeners.append(function)

    def known(self) -> DataFrame:
        """The newest version of the dictionary, empty before the first."""
        path = self.options.dictionary
        return dictionaries.current(self.spark, path) if dictionaries.versions(self.spark, path) else self.spark.createDataFrame([], _ENTRIES)

    def analysed(self, sentences: DataFrame) -> DataFrame:
        """sentences(row_id, raw) -> (row_id, tokens): a phrase begins with content after kana or a mark."""
        words = dict(self.words)
        a = analysers.analyse(sentences.select("row_id", "raw"), "raw", lambda: analysers.LongestMatch(words))
        content = lambda w: ~w["midasi"].rlike("^[ぁ-ゖ]+$|" + context.SEPARATOR)
        starts = F.transform("words", lambda w, i: (i == 0) | (content(w) & ~content(F.element_at("words", F.greatest(i, F.lit(1))))))
        phrases = F.transform(F.sequence(F.lit(1), F.size("words")), lambda n: F.size(F.filter(F.slice("_starts", F.lit(1), n), lambda x: x)))
        joined = F.zip_with("words", "_phrases", lambda w, p: F.struct(w["midasi"].alias("w"), p.cast("int").alias("phrase"), F.lit(None).cast("string").alias("mark"), w["hinsi"].alias("hinsi")))
        return a.where("words is not null and size(words) > 0").withColumn("_starts", starts).withColumn("_phrases", phrases).select("row_id", joined.alias("tokens"))

    def examples(self, sentences: DataFrame) -> DataFrame:
        """Occurrences of katakana words that the dictionary does not know."""
        return context.examples(self.analysed(sentences), "tokens", lambda t: (t["hinsi"] == "未定義語") & t["w"].rlike(_KATAKANA))

    def acquire(self, sentences: DataFrame) -> DataFrame:
        """Induces entries from sentences, registers them as the next version and returns the log of events."""
        found = acquire.induce(self.examples(sentences), self.suffixes, self.options.least_examples, self.options.safe)
        known = self.known()
        outcome = written(dictionaries.register(found.select("stem", "pos_s", "cnt"), known, self.suffixes.select("suffix"), self.options.safe), "registered")
        new = outcome.where("outcome = 'registered'").select("stem", "pos_s", "cnt")
        if not new.isEmpty():
            dictionaries.publish(known.unionByName(new), self.options.dictionary)
        log = dictionaries.event_log(outcome)
        for tell in self.listeners:
            tell(log)
        return log

    def run_stream(self, folder: str, checkpoint: str) -> None:
        """Acquires from the lines of text files as they arrive in a folder, a bounded number of files at a time."""
        lines = self.spark.readStream.option("maxFilesPerTrigger", self.options.files_per_batch).text(folder).select(F.xxhash64("value").alias("row_id"), F.col("value").alias("raw"))
        q = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: self.acquire(batch)).trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()


def merge_dictionaries(parts: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Dictionaries of several workers as one: counts summed, the part of speech by majority. limit: how many are taken."""
    parts = parts[:limit] if limit else parts
    rivals = None
    for p in parts:
        one = p.select("stem", "pos_s", F.lit(1).alias("score"), "cnt")
        rivals = one if rivals is None else rivals.unionByName(one)
    return dictionaries.majority(rivals.groupBy("stem", "pos_s").agg(F.sum("score").alias("score"), F.sum("cnt").alias("cnt")))


def ready_folders(spark: SparkSession, root: str) -> list[str]:
    """Folders under root whose delivery is complete: `name` with a file `name.done` beside it, in the order of names."""
    fs, p = hadoop_path(spark, root)
    names = {s.getPath().getName(): s.isDirectory() for s in fs.listStatus(p)} if fs.exists(p) else {}
    return sorted(f"{root}/{n}" for n, folder in names.items() if folder and f"{n}.done" in names)


def segmentation_changes(sentences: DataFrame, before: dict[str, str], after: dict[str, str]) -> DataFrame:
    """(row_id, start, end, before, after): where another dictionary cuts sentences(row_id, raw) differently."""
    def rows(batches):
        import pandas as pd

        a, b = analysers.LongestMatch(before), analysers.LongestMatch(after)
        for batch in batches:
            out = []
            for i, raw in zip(batch["row_id"], batch["raw"]):
                if raw is not None:
                    text = "".join(raw.split())
                    one, two = ([w for w, _, _ in x.analyse(text)] for x in (a, b))
                    out += [(i, s, e, " ".join(x), " ".join(y)) for s, e, x, y in align.regions(one, two)]
            yield pd.DataFrame(out, columns=["row_id", "start", "end", "before", "after"])

    return sentences.select("row_id", "raw").mapInPandas(rows, "row_id long, start int, end int, before string, after string")
