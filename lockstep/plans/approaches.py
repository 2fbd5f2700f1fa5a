"""Approaches: what scores pairs, how pairs rank users, and the specs that name them.

An approach is a value; its scorer is a function ``(events, window_sec,
min_coactions) -> pairs(u1, u2, score)`` looked up by key, so a new approach is
one registered function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from lockstep.operators.coaction import coaction_counts, synchronous_events
from lockstep.operators.ranking import rank_users, refine, user_scores, valid_mode
from lockstep.operators.weighted import weighted_pairs
from lockstep.session import cut

Scorer = Callable[[DataFrame, float, int], DataFrame]
LEXICOGRAPHIC = "lexicographic"
PLAIN = "coretweets"


@dataclass(frozen=True)
class Kind:
    name: str
    scorer: Scorer


def _weighted(variant: str) -> Scorer:
    return lambda events, window, least: weighted_pairs(events, variant, window, least)


KINDS: dict[str, Kind] = {
    PLAIN: Kind("Co-Retweet", coaction_counts),
    "coretweets_weighted_1day": Kind("Co-Retweet-Weighted-1day", _weighted("1day")),
    "coretweets_weighted_2days": Kind("Co-Retweet-Weighted-2days", _weighted("2days")),
    "coretweets_weighted_12h": Kind("Co-Retweet-Weighted-12h", _weighted("12h")),
}


def register_approach(key: str, name: str, scorer: Scorer) -> None:
    """Make a scorer available under a new key."""
    if key in KINDS or key == LEXICOGRAPHIC:
        raise ValueError(f"there is an approach {key!r} already")
    if not callable(scorer):
        raise TypeError("a scorer takes (events, window_sec, min_coactions)")
    KINDS[key] = Kind(name, scorer)


@dataclass(frozen=True)
class Approach:
    """One pair scorer with its ranking mode.

    With ``filtering`` events are first reduced to accounts with a pair of
    ``filter_min_coactions``, whatever ``min_coactions`` is; the plain count never
    needs it.
    """

    key: str
    window_sec: float = 60
    min_coactions: int = 1
    mode: str = "Linf"
    filtering: bool | None = None
    filter_min_coactions: int = 1

    def __post_init__(self):
        if self.key not in KINDS:
            raise ValueError(f"unknown approach {self.key!r}; one of {sorted(KINDS)}")
        if not valid_mode(self.mode):
            raise ValueError(f"unknown ranking mode {self.mode!r}")
        wanted = self.key != PLAIN if self.filtering is None else self.filtering and self.key != PLAIN
        object.__setattr__(self, "filtering", bool(wanted))

    @property
    def storage_key(self) -> str:
        least = f"_min{self.min_coactions}" if self.min_coactions > 1 else ""
        return f"{self.key}{least}_{self.mode}{'' if self.filtering else '_nofilter'}"

    @property
    def name(self) -> str:
        least = f" min{self.min_coactions}" if self.min_coactions > 1 else ""
        return f"{KINDS[self.key].name}{least} [{self.mode}]{'' if self.filtering else ' NoFilter'}"

    @property
    def metadata(self) -> dict:
        return {"approach_key": self.key, "approach_name": KINDS[self.key].name, "window_sec": self.window_sec, "min_coactions": self.min_coactions, "ranking_mode": self.mode}

    def pairs(self, events: DataFrame) -> DataFrame:
        kept = synchronous_events(events, self.window_sec, self.filter_min_coactions) if self.filtering else events
        return KINDS[self.key].scorer(kept, self.window_sec, self.min_coactions)

    def rank(self, events: DataFrame) -> DataFrame:
        """``(account, grp, pos)`` and the score."""
        return rank_users(user_scores(self.pairs(events), self.mode))


@dataclass(frozen=True)
class Lexicographic:
    """The ranking of the first part, its ties broken by the others in turn."""

    parts: tuple[Approach, ...]
    key: str = field(default=LEXICOGRAPHIC, init=False)

    def __post_init__(self):
        if len(self.parts) < 2:
            raise ValueError("a lexicographic approach has two parts or more")

    @property
    def storage_key(self) -> str:
        return "_".join([LEXICOGRAPHIC, *[p.storage_key for p in self.parts]])

    @property
    def name(self) -> str:
        shown = [p.name if p.key != PLAIN else p.name.removesuffix(" NoFilter") for p in self.parts]
        return "Lexicographic: " + "+".join(shown)

    @property
    def metadata(self) -> dict:
        return {"approach_key": LEXICOGRAPHIC, "sub_approaches": [p.key for p in self.parts], "sub_modes": [p.mode for p in self.parts], "sub_min_coactions": [p.min_coactions for p in self.parts]}

    def rank(self, events: DataFrame) -> DataFrame:
        scored: dict[Approach, DataFrame] = {}

        def part(p: Approach) -> DataFrame:
            # parts that differ in mode only rank the same pairs
            alike = replace(p, mode="Linf")
            if alike not in scored:
                shared = sum(replace(q, mode="Linf") == alike for q in self.parts) > 1
                scored[alike] = cut(p.pairs(events), "pairs") if shared else p.pairs(events)
            return rank_users(user_scores(scored[alike], p.mode))

        first, *rest = (part(p) for p in self.parts)
        return refine(first, *rest)


def _spread(value, size: int, what: str) -> list:
    """One value for all parts, or a list with one for each."""
    if not isinstance(value, list):
        return [value] * size
    if len(value) != size:
        raise ValueError(f"{what} has {len(value)} values for {size} approaches")
    return value


def _count(value, what: str = "min_coactions") -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{what} must be an integer of 1 or more, not {value!r}")
    return value


def _flag(value) -> bool | None:
    if value is not None and not isinstance(value, bool):
        raise ValueError(f"need_filtering must be true or false, not {value!r}")
    return value


def create(spec: str | dict, window_sec: float = 60, min_coactions: int = 1, mode: str = "Linf", filter_min_coactions: int | None = None) -> Approach | Lexicographic:
    """An approach from ``key``, ``key[mode]`` or a dictionary; raises ValueError for anything else.

    Dictionaries have ``name`` and may have ``min_coactions``, ``ranking_mode`` and
    ``need_filtering``; the name ``lexicographic`` takes ``approaches`` and, single
    or as lists, ``ranking_modes``, ``min_coactions`` and ``need_filtering``.
    ``filter_min_coactions``, 1 where it is None, holds for all parts.
    """
    enough = 1 if filter_min_coactions is None else _count(filter_min_coactions, "filter_min_coactions")
    if isinstance(spec, str):
        spec = {"name": spec}
    if not isinstance(spec, dict) or not spec.get("name"):
        raise ValueError("an approach needs a name")
    name = spec["name"]
    if name == LEXICOGRAPHIC:
        subs = spec.get("approaches")
        if not isinstance(subs, list) or len(subs) < 2:
            raise ValueError("a lexicographic approach lists two approaches or more")
        modes = _spread(spec.get("ranking_modes", mode), len(subs), "ranking_modes")
        least = _spread(spec.get("min_coactions", min_coactions), len(subs), "min_coactions")
        flags = _spread(spec.get("need_filtering", True), len(subs), "need_filtering")
        return Lexicographic(tuple(Approach(k, window_sec, _count(c), m, _flag(f), enough) for k, m, c, f in zip(subs, modes, least, flags)))
    base = Approach(name.split("[")[0] if name.endswith("]") else name, window_sec, _count(spec.get("min_coactions", min_coactions)), spec.get("ranking_mode", mode), _flag(spec.get("need_filtering")), enough)
    return replace(base, mode=name[:-1].split("[", 1)[1], filtering=_flag(spec.get("need_filtering"))) if name.endswith("]") else base


def validate(spec: str | dict) -> None:
    """Raise ValueError unless :func:`create` takes the spec."""
    create(spec)


def all_approaches(window_sec: float = 60, min_coactions: int = 1, mode: str = "Linf", filter_min_coactions: int | None = None) -> list[Approach]:
    """One approach per registered key."""
    enough = 1 if filter_min_coactions is None else _count(filter_min_coactions, "filter_min_coactions")
    return [Approach(key, window_sec, min_coactions, mode, filter_min_coactions=enough) for key in KINDS]


def approach_names() -> dict[str, str]:
    return {key: kind.name for key, kind in KINDS.items()}
