"""What a run is asked for, checked before anything is read."""

from __future__ import annotations

from dataclasses import dataclass

from .functions.sketch import checked

STAGES = ("index", "place", "align", "genotype", "consensus")
ALIGNERS = ("seeds", "old")


@dataclass(frozen=True)
class Parameters:
    """k, s, t, l: of the sketch; reads: one file or two mates' files; forced: a node that is taken instead of placing the sample."""

    reads: tuple[str, ...] = ()
    k: int = 19
    s: int = 8
    t: int = 0
    l: int = 3  # noqa: E741
    dust: float = 100.0
    discard: float = 0.0
    stop: str = "consensus"
    aligner: str = "seeds"
    forced: str | None = None

    def __post_init__(self):
        checked(self.k, self.s, self.t, self.l)
        problems = {
            "dust is 0 to 100": 0 <= self.dust <= 100,
            "discard is a share from 0 to 1": 0 <= self.discard <= 1,
            "reads are one file or two": len(self.reads) <= 2,
            f"stop is one of {STAGES}": self.stop in STAGES,
            f"aligner is one of {ALIGNERS}": self.aligner in ALIGNERS,
        }
        for text, good in problems.items():
            if not good:
                raise ValueError(text)
