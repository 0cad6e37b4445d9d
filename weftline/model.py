"""Row types, configuration and the small fixed tables of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("change", T.StringType(), False),
        T.StructField("abs_path", T.StringType(), False),
        T.StructField("repo_root", T.StringType(), True),
        T.StructField("repo_label", T.StringType(), False),
        T.StructField("rel_path", T.StringType(), False),
    ]
)

BATCH = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("raw", T.LongType(), False),
        T.StructField("filtered", T.LongType(), False),
        T.StructField("events", T.ArrayType(EVENT, False), False),
        T.StructField("warnings", T.ArrayType(T.StringType(), False), False),
    ]
)

#: Changes in the order that sorts them.
CHANGES = ("added", "modified", "deleted")

#: Fixed values of the language server protocol: symbol kinds from 1 on.
SYMBOL_KINDS = (
    "File", "Module", "Namespace", "Package", "Class", "Method", "Property", "Field", "Constructor", "Enum",
    "Interface", "Function", "Variable", "Constant", "String", "Number", "Boolean", "Array", "Object", "Key",
    "Null", "EnumMember", "Struct", "Event", "Operator", "TypeParameter",
)

#: Fixed values of the language server protocol: kinds of file events.
FILE_EVENT_TYPES = {"added": 1, "modified": 2, "deleted": 3}

#: Language ids that a client of the protocol may name here, in lower case.
LANGUAGE_IDS = ("python", "typescript", "javascript", "go", "rust", "java", "c", "cpp", "csharp", "ruby", "php", "swift", "kotlin", "scala", "html", "css", "json", "yaml", "markdown", "shellscript")

SEVERITY_ERROR = 1


@dataclass(frozen=True, slots=True)
class WatchConfig:
    """How changes are gathered and filtered. ignore_dirs, ignore_globs and ignore_names (regular expressions) go by the names
    of folders and the base names below every root; force_polling changes nothing, as sources are always polled."""

    # The defaults
    recursive: bool = True
    debounce_ms: int = 1600
    step_ms: int = 50
    force_polling: bool | None = None
    poll_delay_ms: int = 300
    ignore_permission_denied: bool = False
    defaults_filter: bool = True
    gitignore_filter: bool = True
    repo_custom_ignores: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ignore_dirs: tuple[str, ...] = ()
    ignore_globs: tuple[str, ...] = ()
    ignore_names: tuple[str, ...] = ()
    git_timeout_s: float = 10.0
    git_chunk_size: int = 4000
    coalesce_events: bool = True


def symbol_kinds(spark: SparkSession) -> DataFrame:
    """(kind, kind_name), 26 rows."""
    return spark.createDataFrame(list(enumerate(SYMBOL_KINDS, 1)), "kind int, kind_name string")
