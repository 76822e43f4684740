"""Named dictionaries, and segmenting one text with them on the driver."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .dictionary import Dictionary
from .lattice import segment_text


class Registry:
    """Dictionaries by name, which is any string; a name is never given twice."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def load_dict(self, file_path: str, dict_name: str) -> tuple[str, bool]:
        if dict_name in self.known:
            return f"Failed: dictionary name {dict_name} already exists, please use another name.", False
        path = file_path if "://" in file_path else os.path.abspath(file_path)
        self.known[dict_name] = Dictionary.from_file(self.spark, path)
        return f"Successful: file {path} has been successfully loaded to dictionary name {dict_name}.", True

    def put(self, dict_name: str, dictionary: Dictionary) -> None:
        """Replaces a dictionary, for example by one with added or removed words."""
        self.known[dict_name] = dictionary

    def add(self, dict_name: str, words: Iterable[str] | DataFrame) -> None:
        self.put(dict_name, self.dictionary(dict_name).add(words))

    def remove(self, dict_name: str, words: Iterable[str] | DataFrame) -> None:
        self.put(dict_name, self.dictionary(dict_name).remove(words))

    def dictionary(self, dict_name: str) -> Dictionary:
        if dict_name not in self.known:
            raise RuntimeError(f"Dictionary name {dict_name} does not exist.")
        return self.known[dict_name]

    def segment(self, text: str, dict_name: str, safe: bool = False, parallel: bool = False) -> list[str]:
        """Tokens of one text; anything but a non-empty string has none.  ``parallel``
        is accepted and makes no difference: columns are segmented in parallel."""
        if not text or not isinstance(text, str):
            return []
        return segment_text(text, self.dictionary(dict_name).compiled.value, safe)
