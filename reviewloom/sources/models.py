"""Persistence of the serving artefact."""

from __future__ import annotations

from reviewloom.operators.models import SentimentModel


def save_model(model: SentimentModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> SentimentModel:
    """Load a fitted model as a whole; a missing or incomplete one is an error at once, not at first use."""
    return SentimentModel.load(path)
