"""What a process is told from outside, and how it says what it does."""

from __future__ import annotations

import json
import logging
import os
import sys
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from lectern.operators.vectors import provider


@dataclass(frozen=True)
class Settings:
    """The folder of the given documents, and the provider of vectors with its model and key."""

    documents: str = "samples"
    embeddings: str = "local"
    model: str = "text-embedding-3-small"
    key: str | None = None

    @classmethod
    def from_environment(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """From DOCUMENTS, EMBEDDINGS, EMBEDDING_MODEL and OPENAI_API_KEY; what is not set keeps its default."""
        names = {"documents": "DOCUMENTS", "embeddings": "EMBEDDINGS", "model": "EMBEDDING_MODEL", "key": "OPENAI_API_KEY"}
        return cls(**{field: env[name] for field, name in names.items() if env.get(name)})

    def provider(self) -> Any:
        return provider(self.embeddings, self.key, self.model)

    def corpus(self, spark) -> Any:
        """A collection over the documents of the folder."""
        from lectern.operators.corpus import Corpus
        from lectern.sources.folder import read_folder

        return Corpus(spark, read_folder(spark, self.documents), self.provider())


class JsonLines(logging.Formatter):
    """One JSON object a line: at, level, message, and the fields of ``extra={"detail": {...}}``."""

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc).isoformat(timespec="milliseconds")
        return json.dumps({"at": at, "level": record.levelname.lower(), "message": record.getMessage()} | getattr(record, "detail", {}), ensure_ascii=False)


def log_to(stream=None) -> logging.Handler:
    """Let the package write its log as JSON lines, to standard output unless told otherwise."""
    handler = logging.StreamHandler(stream or sys.stdout)
    handler.setFormatter(JsonLines())
    log = logging.getLogger("lectern")
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    return handler
