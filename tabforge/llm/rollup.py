"""Delta-maintained token rollups.

A store holds versions of additive totals by source, language and tokenizer version.  A batch of signed changes (inserts,
deletes, revised counts) becomes one delta per group, and a commit writes the next version: the totals plus the delta.  A version
counts once its pointer, which names its folder and its batch, exists.  Pointers come into being whole and only where none is, so that of two
writers one wins and a writer that dies leaves nothing that anyone reads.  A batch that has been applied is never applied again: the last
pointer names its batch, and each earlier batch has a mark, which the next commit makes good if its writer died before.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import map_arrow, shared_folder, table, written
from tabforge.llm.text import words
from tabforge.llm.tokens import byte_tokenizer

KEYS = ("source", "lang", "tokenizer_version")
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class Conflict(RuntimeError):
    """Another writer committed this version first; read the store again and retry."""


class RollupStore:
    """Totals in a folder that all executors share; its files are reached through Spark's own file systems.

    The file system must be a local one, or one whose rename never replaces a file, such as HDFS.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.folder}/{name}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def _write(self, text: str) -> str:
        """A new file of its own with the text; its name."""
        name = f"pending/{uuid.uuid4().hex}"
        out = self.fs.create(self.path(f"{self.folder}/{name}"), False)
        out.writeUTF(text)
        out.close()
        return name

    def _publish(self, pending: str, name: str) -> bool:
        """Gives a whole file its name in one step; False if the name is taken."""
        source, target = (self.path(f"{self.folder}/{n}") for n in (pending, name))
        self.fs.mkdirs(target.getParent())
        if self.fs.getUri().getScheme() != "file":
            if self.fs.rename(source, target):
                return True
            if self.fs.exists(target):
                return False
            raise OSError(f"{pending} could not be renamed to {name}")
        files = self.spark._jvm.java.nio.file.Files
        try:  # a local rename would replace a file; a link never does
            files.createLink(*(self.spark._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, source)))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def _current(self) -> tuple[int, dict[str, str]]:
        """The last committed version, its folder and its batch."""
        pointers = self.path(f"{self.folder}/commits")
        found = [s.getPath().getName() for s in self.fs.listStatus(pointers)] if self.fs.exists(pointers) else []
        last = max((int(m[1]) for n in found if (m := re.fullmatch(r"(\d+)", n))), default=0)
        return last, json.loads(self._read(f"commits/{last}")) if last else {}

    def totals(self) -> DataFrame:
        _, head = self._current()
        return self.spark.read.schema(TOTALS).parquet(f"{self.folder}/versions/{head['folder']}") if head else self.spark.createDataFrame([], TOTALS)

    @staticmethod
    def _mark(batch_id: str) -> str:
        return f"batches/{hashlib.sha256(batch_id.encode()).hexdigest()}"

    def applied(self, batch_id: str) -> bool:
        _, head = self._current()
        return head.get("batch") == batch_id or self.fs.exists(self.path(f"{self.folder}/{self._mark(batch_id)}"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Applies a batch of changes (see ``deltas``) once; False if it was applied before.

        Whatever a failed or beaten commit wrote is not pointed to, and never read.  Conflict if another writer was first: nothing was applied.
        """
        version, head = self._current()
        if head:  # its writer may have died before the mark
            self._publish(self._write(head["batch"]), self._mark(head["batch"]))
        if self.fs.exists(self.path(f"{self.folder}/{self._mark(batch_id)}")):
            return False
        name = uuid.uuid4().hex
        before = self.spark.read.schema(TOTALS).parquet(f"{self.folder}/versions/{head['folder']}") if head else self.spark.createDataFrame([], TOTALS)
        merged = before.unionByName(deltas(changes)).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        merged.where("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{self.folder}/versions/{name}")
        if not self._publish(self._write(json.dumps({"folder": name, "batch": batch_id})), f"commits/{version + 1}"):
            raise Conflict(f"version {version + 1} exists")
        self._publish(self._write(batch_id), self._mark(batch_id))
        return True


def deltas(changes: DataFrame) -> DataFrame:
    """Additive deltas by group of changes (source, lang, tokenizer_version, op, n_tokens, old_tokens).

    An insert adds its document and tokens, a delete takes them back, and a revision changes tokens from old_tokens to n_tokens.  Null counts
    are 0, null groups are groups, and rows with another op are an error.  Rows are summed before they are shuffled, so that no group is hot.
    """
    n, old = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
    op = lambda a, b, c: F.when(F.col("op") == "insert", a).when(F.col("op") == "delete", b).when(F.col("op") == "revise", c).otherwise(F.raise_error(F.concat(F.lit("no such op: "), F.coalesce("op", F.lit("null")))).cast("long"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    signed = changes.select(*KEYS, op(one, -one, none).alias("n_docs"), op(n, -n, n - old).alias("n_tokens"))
    return signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def counted(docs: DataFrame, tokenizers: str | None = None) -> DataFrame:
    """(doc_id, source, lang, copy, raw, clean, n_words) of each row: a digest of the text, tokens as it is and with runs of white space as
    one space, and words.  Null texts are empty."""

    def make(batches):
        import hashlib

        encode = byte_tokenizer(tokenizers).ids
        runs = re.compile(r"\s+")
        for b in batches:
            n_words = np.zeros(b.num_rows, np.int64)
            for w in words(b.column("text"), whole=False):
                n_words[w.first : w.first + len(w.at) - 1] += np.diff(w.at)
            raw, clean, copy = [], [], []
            for t in b.column("text"):
                t = t.as_py() or ""
                raw.append(len(encode(t)))
                once = runs.sub(" ", t)
                clean.append(raw[-1] if once == t else len(encode(once)))
                copy.append(hashlib.blake2b(t.encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), pa.array(copy, pa.binary()), pa.array(raw, pa.int64()), pa.array(clean, pa.int64()), pa.array(n_words)], ["doc_id", "source", "lang", "copy", "raw", "clean", "n_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "source", "lang", "text"), make, f"doc_id {kind}, source string, lang string, copy binary, raw long, clean long, n_words long")


def op9_token_rollup(spark, sf_dir: str) -> DataFrame:
    """Totals of all of ``documents`` after four commits, a row for each source, language and tokenizer version: every document is inserted under
    two tokenizer versions; exact copies of a smaller doc_id are deleted; counts of the rest are revised to the text with single spaces; and the
    deletes arrive once more, to no effect.

    Rows are counted one by one, whether they repeat or not; rows without doc_id are no one's copies; null sources and languages are groups, null
    texts are empty.
    """
    counts = written(counted(table(spark, sf_dir, "documents")), "counts")
    versions = lambda bpe: F.explode(F.array(F.struct(F.lit("byte_bpe_50k").alias("tokenizer_version"), F.col("raw").alias("old_tokens"), F.col(bpe).alias("n_tokens")), F.struct(F.lit("words_1").alias("tokenizer_version"), F.col("n_words").alias("old_tokens"), F.col("n_words").alias("n_tokens"))))
    rows = lambda df, op, bpe: df.select("source", "lang", versions(bpe).alias("v")).select("source", "lang", "v.*", F.lit(op).alias("op"))
    firsts = written(counts.groupBy("copy").agg(F.min("doc_id").alias("first")), "firsts")  # so that the join can split a hot text
    marked = counts.join(firsts, "copy")
    deletes = rows(marked.where("doc_id > first"), "delete", "raw")
    revised = rows(marked.where("not coalesce(doc_id > first, false)"), "revise", "clean")
    store = RollupStore(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    for batch, changes in (("insert-1", rows(counts, "insert", "raw")), ("delete-1", deletes), ("revise-1", revised), ("delete-1", deletes)):
        store.commit(batch, changes)
    return store.totals()
