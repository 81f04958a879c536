"""The id coder as compiled code in the executors' JVMs.

``IdCoder.java`` is compiled once by the compiler that Spark itself ships for its generated code. The classes go as a jar
into the shared folder and from there to the executors, as with any added jar; nothing is installed.
"""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillon.storage import fresh_path

DOCUMENT = "doc_id: bigint, inside: bigint, n_tokens: bigint, ids_crc32: bigint, ids: binary"
_NAMES = {"EncodeIds": ("quillon_encode_ids", "binary"), "DecodeIds": ("quillon_decode_ids", f"array<struct<{DOCUMENT}>>")}
_READY: dict[str, object] = {}


def _classes(spark: SparkSession):
    """A class loader of the driver with the compiled classes; their jar is added once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _READY:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook((Path(__file__).parent / "IdCoder.java").read_text())
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as jar:
            for name, code in dict(compiler.getBytecodes()).items():
                jar.writestr(name.replace(".", "/").removesuffix("/class") + ("" if name.endswith(".class") else ".class"), bytes(code))
        path = fresh_path(spark, "coder") + ".jar"
        target = jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(packed.getvalue())
        out.close()
        spark._jsc.addJar(path)
        _READY.clear()
        _READY[app] = compiler.getClassLoader()
    return _READY[app]


def _function(spark: SparkSession, name: str) -> str:
    called, ddl = _NAMES[name]
    made = _classes(spark).loadClass(f"quillon.{name}").newInstance()
    spark._jsparkSession.udf().register(called, made, spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(ddl))
    return called


def encoded(spark: SparkSession, head: str, raw: str, length: str) -> Column:
    """Whole payloads from their heads, ids (little-endian, unsigned 32 bits) and block lengths."""
    return F.call_function(_function(spark, "EncodeIds"), F.col(head), F.col(raw), F.col(length))


def decoded(spark: SparkSession, payload: str, with_ids: bool) -> Column:
    """The documents of a payload, an array; a wrong checksum fails the task."""
    return F.call_function(_function(spark, "DecodeIds"), F.col(payload), F.lit(with_ids))
