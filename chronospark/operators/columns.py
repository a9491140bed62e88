"""Blocks that choose and rename columns. mapping says of a list of columns which stay, as {new name: name}."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.names import PREDICTION, PROBABILITY, select
from ..plans.blocks import Block, renamed


class Choice(Block):
    learns = False

    def mapping(self, features: list[str]) -> dict[str, str]:
        raise NotImplementedError

    def process(self, frame, run, path):
        return frame.only(list(self.mapping(list(frame.features))))


class Renaming(Choice):
    def process(self, frame, run, path):
        return renamed(frame, {old: new for new, old in self.mapping(list(frame.features)).items() if old != new})


@dataclass(frozen=True)
class SelectColumns(Choice):
    columns: object
    name: str = "select"

    def mapping(self, features):
        return {f: f for f in select(self.columns, features)}


@dataclass(frozen=True)
class DropColumns(Choice):
    columns: object
    name: str = "drop"

    def mapping(self, features):
        gone = set(select(self.columns, features))
        return {f: f for f in features if f not in gone}


@dataclass(frozen=True)
class RenameColumns(Renaming):
    mapper: dict
    name: str = "rename"

    def mapping(self, features):
        return {self.mapper.get(f, f): f for f in features}


@dataclass(frozen=True)
class AddColumnSuffix(Renaming):
    suffix: str
    name: str = "suffix"

    def mapping(self, features):
        return {f + self.suffix: f for f in features}


@dataclass(frozen=True)
class OnlyPredictions(Choice):
    name: str = "only predictions"

    def mapping(self, features):
        return {f: f for f in features if f.startswith(PREDICTION)}


@dataclass(frozen=True)
class OnlyProbabilities(Choice):
    name: str = "only probabilities"

    def mapping(self, features):
        return {f: f for f in features if f.startswith(PROBABILITY)}
