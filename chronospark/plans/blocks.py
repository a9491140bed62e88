"""What pipelines are made of: frames of rows, and blocks that fit on train rows and apply to all.

A frame's rows carry split_id and train (whether the row is one to learn from).
A block turns into a grouped aggregate over train rows, whose result has one row
a split and is broadcast, and into a projection. A state is
fetched as soon as it is fitted; the number of jobs doesn't depend on the number of splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.names import c, select
from ..functions.rows import blocked

#: Columns of a frame that aren't features.
KEYS = ("split_id", "train", "halo", "rid", "ts", "y", "weight", "raw_y", "_role", "_run", "_block", "_halo", "_place")


@dataclass(frozen=True)
class Frame:
    """Rows, the columns that are features, hidden columns that blocks pass on, what window partitions are, and rows that later steps look back."""

    df: DataFrame
    features: tuple[str, ...]
    carry: tuple[str, ...] = ()
    by: tuple[str, ...] = ("split_id", "_role")
    ahead: int = 0

    @property
    def window(self) -> WindowSpec:
        """Rows of one split, train and test rows apart, in order; where the frame is cut into blocks, those of one block and their context."""
        return Window.partitionBy(*self.by).orderBy("rid")

    @property
    def keys(self) -> list[str]:
        return [k for k in self.df.columns if k in KEYS or k.startswith("event_") or k in self.carry or k in self.by]

    def only(self, features: list[str]) -> Frame:
        """The frame with these of its columns as features."""
        keys = self.keys
        return replace(self, df=self.df.select(*[c(k) for k in keys], *[c(f) for f in features if f not in keys]), features=tuple(features))

    def add(self, columns: dict[str, Column], keep: list[str] | None = None) -> Frame:
        """New columns, computed together; keep: the features that stay (all if None)."""
        stay = [f for f in (self.features if keep is None else keep) if f not in columns]
        df = self.df.select(*[c(k) for k in self.keys], *[c(f) for f in stay], *[x.alias(name) for name, x in columns.items()])
        return replace(self, df=df, features=(*stay, *columns))

    def on(self, df: DataFrame) -> Frame:
        return replace(self, df=df)

    def hide(self, tag: str, names: list[str] | None = None) -> tuple[Frame, dict[str, str]]:
        """The frame with copies of columns that blocks pass on untouched; {name: hidden name}."""
        hidden = {n: f"_{tag}_{i}" for i, n in enumerate(self.features if names is None else names)}
        df = self.df.select("*", *[c(n).alias(h) for n, h in hidden.items()])
        return replace(self, df=df, carry=(*self.carry, *hidden.values())), hidden

    def restore(self, hidden: dict[str, str]) -> Frame:
        """The hidden columns as the features again (they also stay hidden)."""
        df = self.df.select(*[c(k) for k in self.keys], *[c(h).alias(n) for n, h in hidden.items()])
        return replace(self, df=df, features=tuple(hidden))

    def set(self, **columns: Column) -> Frame:
        return self.on(self.df.withColumns(columns))

    def train_rows(self) -> DataFrame:
        # _role is what windows are parted by, so this filter goes below them
        return self.df.where("_role AND train" if "_role" in self.df.columns else "train")


class Run:
    """One pass over a pipeline: fits and keeps states, or uses kept ones.

    states maps a block's place in the pipeline to a table of one row a split; labels
    names those that say something to a reader, wherever in the pipeline they are.
    """

    def __init__(self, states: dict[str, DataFrame] | None = None):
        self.fitting = states is None
        self.models: dict[str, dict] = {}
        self.labels: dict[str, str] = {}
        self.states: dict[str, DataFrame] = {} if states is None else states

    def state(self, path: str, fit: Callable[[], DataFrame]) -> DataFrame:
        """A block's state; it is fitted once, and as it has a row a split, a number planned on the driver, it is kept there."""
        if self.fitting:
            made = fit()
            self.states[path] = made.sparkSession.createDataFrame(made.collect(), made.schema)
        return self.states[path]

    def joined(self, path: str, frame: Frame, fit: Callable[[], DataFrame]) -> DataFrame:
        """The frame's rows beside their split's state; a state has a row a split, a number planned on the driver."""
        return frame.df.join(F.broadcast(self.state(path, fit)), "split_id", "left")


class Block:
    """A step of a pipeline.

    learns: whether it needs train rows. parallel: whether its children see the same
    rows, not one what the other made. memory: rows of context before a test window that its values need. reach:
    rows that its windows look back inside a window. unbounded: whether they
    look back without a bound and can't be put together from blocks of rows.
    windowed: whether they look back at all.
    """

    memory = 0
    unbounded = False
    learns = True
    parallel = True
    name = ""

    @property
    def reach(self) -> int:
        return self.memory

    @property
    def windowed(self) -> bool:
        return self.reach > 0

    def process(self, frame: Frame, run: Run, path: str) -> Frame:
        raise NotImplementedError

    def fit(self, frame: Frame, run: Run, path: str) -> None:
        """Leaves the block's states in run; no more is needed of the rows."""
        self.process(frame, run, path)

    def fit_at_once(self, rows: DataFrame, features: tuple[str, ...], splits: list, run: Run, path: str) -> bool:
        """Leaves the block's states of all splits in run, from rows that aren't repeated by split; False if it can't."""
        return False

    def children(self) -> list:
        return []

    def tunable(self) -> dict[str, list]:
        return getattr(self, "params_to_try", None) or {}


@dataclass(frozen=True)
class Project(Block):
    """A stateless block from a function of the frame."""

    fn: Callable[[Frame], Frame]
    memory: int = 0
    name: str = "project"
    learns = False

    def process(self, frame, run, path):
        return self.fn(frame)


@dataclass(frozen=True)
class Identity(Block):
    name: str = "identity"
    learns = False

    def process(self, frame, run, path):
        return frame

    def inverse(self, frame: Frame, run: Run, path: str, names: list[str]) -> Frame:
        return frame


def as_block(item) -> Block:
    """A block as it is; a list as a sequence; a callable of a frame's DataFrame as a function block."""
    from ..operators.features import ApplyFunction
    from ..operators.models import FromMl, FromMlTransformation, is_estimator, predicts

    if isinstance(item, Block):
        return item
    if isinstance(item, (list, tuple)):
        return Sequence(tuple(item))
    if is_estimator(item):
        return FromMl(item) if predicts(item) else FromMlTransformation(item)
    if callable(item):
        return ApplyFunction(item)
    raise TypeError(f"not a block: {item!r}")


@dataclass(frozen=True)
class Sequence(Block):
    steps: tuple
    name: str = "sequence"
    parallel = False

    @property
    def learns(self):
        return any(b.learns for b in self.children())

    def process(self, frame, run, path):
        return in_turn(frame, self.children(), lambda i, step, frame: step.process(frame, run, f"{path}/{i}"))

    def children(self):
        return [as_block(s) for s in self.steps]


def in_turn(frame: Frame, steps: list[Block], apply: Callable[[int, Block, Frame], Frame]) -> Frame:
    """The frame after steps, each of which is told how far those behind it look back."""
    outer = frame.ahead
    for i, step in enumerate(steps):
        frame = apply(i, step, replace(frame, ahead=outer + sum(map(reach_of, steps[i + 1 :]))))
    return replace(frame, ahead=outer)


def traverse(block: Block) -> Iterator[Block]:
    yield block
    for child in block.children():
        yield from traverse(child)


def reach_of(pipeline) -> int:
    """Rows that a pipeline's windows look back inside a window: steps on steps add up, of blocks side by side the longest counts."""
    block = as_block(pipeline)
    below = [reach_of(b) for b in block.children()]
    return block.reach + (max(below, default=0) if block.parallel else sum(below))


def memory_of(pipeline) -> int:
    """The most rows of context any block needs: the greatest, not the sum, so chained windows are cut at a test window's edge."""
    return max(b.memory for b in traverse(as_block(pipeline)))


def cut(df: DataFrame, pipeline, place: str = "rid") -> DataFrame:
    """df with _block and _halo so that a pipeline's windows find all rows they look back at in one block: chained windows add up."""
    blocks = list(traverse(as_block(pipeline)))
    if any(b.unbounded for b in blocks) or not any(b.windowed for b in blocks):
        return df.withColumns({"_block": F.lit(0).cast("long"), "_halo": F.lit(False)})
    return blocked(df, reach_of(pipeline), 0, place=place)


def bounded(pipeline) -> bool:
    """Whether all windows of a pipeline look back a stated number of rows."""
    return all(not b.unbounded and (b.reach > 0 or not b.windowed) and not getattr(b, "so_far", False) for b in traverse(as_block(pipeline)))


def names_of(pipeline) -> str:
    return "->".join(b.name or type(b).__name__ for b in traverse(as_block(pipeline)) if not b.children())


def chosen(frame: Frame, patterns) -> list[str]:
    return select(patterns, list(frame.features))


def renamed(frame: Frame, mapper: dict[str, str]) -> Frame:
    names = [mapper.get(f, f) for f in frame.features]
    return replace(frame, df=frame.df.withColumnsRenamed({a: b for a, b in mapper.items() if a in frame.features}), features=tuple(names))

