"""Registered queries and their SQL, by theme."""

from __future__ import annotations

from cairn.plans import chat, drift, evaluation, ingest, retrieval, streams, text

MODULES = [retrieval, ingest, text, evaluation, chat, streams, drift]
