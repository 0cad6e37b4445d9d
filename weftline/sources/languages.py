"""Language configuration: [[language]] tables of a TOML file."""

from __future__ import annotations

import tomllib
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

LANGUAGE = "name string, suffixes array<string>, server string, server_args array<string>"


def parse_languages(raw: dict) -> list[tuple[str, list[str], str, list[str]]]:
    """Validated rows of a parsed file; ValueError says what is wrong. Suffixes and arguments default to none."""
    entries = raw.get("language", [])
    if not isinstance(entries, list):
        raise ValueError("the file must have [[language]] tables")
    out = []
    for entry in entries:
        if not isinstance(entry, dict):
            raise ValueError("each [[language]] must be a table")
        if not (name := entry.get("name")):
            raise ValueError("a [[language]] table has no name")
        if not (server := entry.get("server")):
            raise ValueError(f"language {name} has no server")
        lists = []
        for key in ("suffixes", "server_args"):
            if not isinstance(value := entry.get(key, []), list):
                raise ValueError(f"{key} of language {name} must be a list")
            lists.append([str(v) for v in value])
        out.append((str(name), lists[0], str(server), lists[1]))
    return out


def load_languages(spark: SparkSession, path: str | Path) -> DataFrame:
    with open(path, "rb") as f:
        return spark.createDataFrame(parse_languages(tomllib.load(f)), LANGUAGE)


def languages_of(texts: DataFrame, key: str) -> DataFrame:
    """(key, LANGUAGE) of many files' texts (key, text), parsed in the tasks."""

    def parse(frames):
        for frame in frames:
            yield pd.DataFrame([(k, *row) for k, text in zip(frame[key], frame["text"], strict=True) for row in parse_languages(tomllib.loads(text))], columns=[key, "name", "suffixes", "server", "server_args"])

    return texts.select(key, "text").mapInPandas(parse, f"{key} {texts.schema[key].dataType.simpleString()}, {LANGUAGE}")
