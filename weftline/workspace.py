"""One language's view of a workspace: lifecycle, capabilities, queries over fact tables, diagnostics and change notices."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from weftline.functions.text import LANGUAGE_IDS
from weftline.operators import changes, intel
from weftline.operators.symbolindex import SymbolIndex
from weftline.streaming import diagnostics as live
from weftline.streaming import facts as store
from weftline.streaming import watch

#: What answers are available, by the protocol's names.
PROVIDERS = ("document_symbol_provider", "workspace_symbol_provider", "definition_provider", "type_definition_provider", "references_provider", "hover_provider", "call_hierarchy_provider", "rename_provider")

#: What a client of pushed diagnostics understands.
PUSHED_DIAGNOSTICS = {"publish_diagnostics": {"related_information": True, "tag_support": True, "code_description": True, "data": True}}


@dataclass
class Workspace:
    """Use as a context manager. facts: symbols, occurrences, calls (any may be missing, and its queries with it)."""

    spark: SparkSession
    language: str
    suffixes: Sequence[str] = ()
    facts: dict[str, DataFrame] = field(default_factory=dict)
    diagnostics_table: str | None = None
    send: Callable[[list[tuple[str, int]]], None] = lambda rows: None
    servers: Sequence[Callable[[], dict | None]] = ()
    index: store.FactStore | None = None
    symbol_index: SymbolIndex | None = None
    _capabilities: dict[str, bool] | None = None
    _open: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        if self.language.lower() not in LANGUAGE_IDS:
            raise ValueError(f"unknown language {self.language}; valid ids include {', '.join(LANGUAGE_IDS[:5])}")
        self.language = self.language.lower()

    def __enter__(self) -> Workspace:
        """Takes the first fact server that is usable, in order, or else what the given facts can answer."""
        for server in self.servers:
            if (found := server()) is not None:
                self.facts = found
                break
        else:
            if self.servers:
                self.default_servers()
        needs = {"document_symbol_provider": {"symbols"}, "workspace_symbol_provider": {"symbols"}, "definition_provider": {"occurrences"}, "type_definition_provider": {"occurrences", "symbols"}, "references_provider": {"occurrences"}, "hover_provider": {"occurrences", "symbols"}, "call_hierarchy_provider": {"calls", "symbols"}, "rename_provider": {"occurrences"}}
        self._capabilities = {p: needs[p] <= self.facts.keys() for p in PROVIDERS}
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """May be called again; nothing is left open."""
        self._open.clear()
        self._capabilities = None

    def default_servers(self) -> None:
        """There is none to fall back on."""
        raise RuntimeError("no server of facts is usable, and there are no default ones")

    def supports(self, capability: str) -> bool:
        return bool((self._capabilities or {}).get(capability, False))

    @staticmethod
    def client_capabilities() -> dict:
        return PUSHED_DIAGNOSTICS

    @contextmanager
    def open_files(self, *uris: str) -> Iterator[None]:
        """Files that are open within the block."""
        fresh = set(uris) - self._open
        self._open |= fresh
        try:
            yield
        finally:
            self._open -= fresh

    def is_open(self, uri: str) -> bool:
        return uri in self._open

    def _need(self, capability: str) -> None:
        if not self.supports(capability):
            raise RuntimeError(f"{capability} is not available")

    def document_symbols(self, uri: str) -> DataFrame:
        """The file's outline, however deep."""
        self._need("document_symbol_provider")
        return intel.walk(intel.document_symbols(self.facts["symbols"], uri))

    def workspace_symbols(self, query: str) -> DataFrame:
        """By the stored index of names if there is one (as of when it was built), else by a scan."""
        self._need("workspace_symbol_provider")
        if self.symbol_index is not None:
            return self.symbol_index.search(query)
        return intel.workspace_symbols(self.facts["symbols"], query)

    def _at(self, uri: str, line: int, char: int) -> DataFrame:
        return self.spark.createDataFrame([(0, uri, line, char)], "request_id int, uri string, line int, char int")

    def definition(self, uri: str, line: int, char: int) -> DataFrame:
        self._need("definition_provider")
        return intel.definitions(self.facts["occurrences"], self._at(uri, line, char)).drop("request_id")

    def type_definition(self, uri: str, line: int, char: int) -> DataFrame:
        self._need("type_definition_provider")
        return intel.type_definitions(self.facts["occurrences"], self.facts["symbols"], self._at(uri, line, char)).drop("request_id")

    def references(self, uri: str, line: int, char: int, include_declaration: bool = True) -> DataFrame:
        self._need("references_provider")
        return intel.references(self.facts["occurrences"], self._at(uri, line, char), include_declaration).drop("request_id")

    def hover(self, uri: str, line: int, char: int) -> DataFrame:
        self._need("hover_provider")
        return intel.hover(self.facts["occurrences"], self.facts["symbols"], self._at(uri, line, char)).drop("request_id")

    def _called(self, uri: str, line: int, char: int) -> DataFrame:
        return intel.at_position(self.facts["occurrences"], self._at(uri, line, char)).select("symbol_id")

    def incoming_calls(self, uri: str, line: int, char: int) -> DataFrame:
        self._need("call_hierarchy_provider")
        return intel.incoming_calls(self.facts["calls"], self.facts["symbols"], self._called(uri, line, char))

    def outgoing_calls(self, uri: str, line: int, char: int) -> DataFrame:
        self._need("call_hierarchy_provider")
        return intel.outgoing_calls(self.facts["calls"], self.facts["symbols"], self._called(uri, line, char))

    def rename_edits(self, uri: str, line: int, char: int, new_name: str) -> DataFrame:
        self._need("rename_provider")
        from pyspark.sql import functions as F

        return intel.rename_edits(self.facts["occurrences"], self._at(uri, line, char).withColumn("new_name", F.lit(new_name))).drop("request_id")

    def get_diagnostics(self, uri: str, timeout: float = 5.0, newer_than: int = -1) -> list[str]:
        """The latest pushed for the file: at once if there is one with a push_seq over newer_than, else after waiting
        for such a push; what there is when the time is up; never None."""
        return live.wait_for(self.spark, self.diagnostics_table, uri, timeout, newer_than) if self.diagnostics_table else []

    def notify_file_changes(self, events: DataFrame, number: int | None = None) -> None:
        """Sends a batch's events (seq, change, abs_path) that this language takes, and nothing if none remain.

        With an index the changed files are parsed again and queries see their new facts; number: the batch's, so that one that is
        told twice is indexed once (None: a new batch).
        """
        numbers = {"Created": 1, "Changed": 2, "Deleted": 3}
        self.notify_raw([(r["uri"], numbers[r["type"]]) for r in changes.translate(events, self.suffixes).orderBy("seq").toLocalIterator()])
        if self.index is not None:
            if number is None:
                number = self.index.commit()["sources"].get(self.language, -1) + 1
            self.index.apply(store.with_texts(changes.by_suffix(events, self.suffixes)), number, self.language)
            self.facts = self.facts | {t: self.index.facts(t) for t in self.index.tables}

    def notify_raw(self, rows: Sequence[tuple[str, int]]) -> None:
        watch.notify_raw(self.send, rows)
