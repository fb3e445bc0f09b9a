"""Team shorthand: single characters that stand for members, and repairs of misheard ones."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.phonetic import ratio
from lexweave.operators.correction import containment_spans

# Words that announce a team, characters too common to be members, words next to a team,
# equipment words that are no team, and reviewed repairs.
TRIGGERS = ("配队", "阵容", "队伍", "队", "组队", "战队", "组合", "搭配", "加", "带", "那芙", "芙万", "芙白", "万白", "草行久", "万达", "胡行钟", "雷国", "雷九", "神鹤", "融甘", "胡夜", "提八", "三神", "纯水队", "蒸发队", "融化队", "感电队", "超载队", "绽放队", "激化队", "永冻队", "岩队", "风队", "雷队", "火队")
AMBIGUOUS = ("莱", "夏", "爱", "玛", "娜", "琳", "一", "九", "五", "七")
AFTER, BEFORE = ("队", "组合", "阵容", "配队", "队伍"), ("带", "加", "配", "和")
EQUIPMENT = ("标准", "输出", "生成", "输出套", "输出装", "生成装", "标准输出", "标准生成")
REVIEWED = {"琴谱": ("琴芙", ("琴", "芙宁娜"))}
NEAREST, OVERRIDE_SCORE, SLOT_SCORE = 88.0, 0.95, 0.86

PIECE = re.compile("[一-鿿]{2,6}")
REPAIR = "surface string, value string, score double, source string, parent string, start_char int, end_char int"


@dataclass
class Team:
    """slots: character -> member; at most one per character of the script, so a dict is bounded."""

    slots: Mapping[str, str]
    readings: Mapping[str, str]
    reviewed: Mapping[str, tuple[str, tuple[str, ...]]] = field(default_factory=lambda: dict(REVIEWED))

    def __post_init__(self) -> None:
        self.usable = {c: who for c, who in self.slots.items() if c not in AMBIGUOUS}

    def members(self, text: str | None) -> list[tuple[str, str]]:
        """(character, member) in runs of which at least half are members."""
        pieces = PIECE.findall(text or "")
        known = [[c for c in p if c in self.usable] for p in pieces]
        return [(c, self.usable[c]) for p, k in zip(pieces, known, strict=True) if 2 * len(k) >= len(p) for c in k]

    def beside_team(self, text: str, start: int, end: int) -> bool:
        return text[end : end + 2].startswith(AFTER) or text[max(0, start - 2) : start].endswith(BEFORE)

    def nearest(self, char: str) -> str | None:
        """The member character that sounds most like char; the first one on ties."""
        own = self.readings.get(char)
        scored = [(ratio(own, self.readings.get(c, "")), c) for c in self.usable] if own else []
        top = max(scored, key=lambda x: x[0], default=(0.0, None))
        return top[1] if top[0] >= NEAREST else None

    def rebuilt(self, surface: str) -> tuple[str, tuple[str, ...]] | None:
        """The surface with each stranger replaced; needs a member and a stranger to begin with."""
        chars = [c if c in self.usable else self.nearest(c) for c in surface]
        if None in chars or not any(c in self.usable for c in surface) or "".join(chars) == surface:
            return None
        return "".join(chars), tuple(self.usable[c] for c in chars)

    def is_equipment(self, text: str, start: int, end: int) -> bool:
        return any(x in text[max(0, start - 4) : end + 4] for x in EQUIPMENT)

    def repair(self, text: str | None, surface: str | None) -> tuple | None:
        """A row of REPAIR for a surface that was asked for, or None."""
        if not text or not surface or not 2 <= len(surface) <= 6 or surface not in text:
            return None
        start = text.index(surface)
        end = start + len(surface)
        if not self.beside_team(text, start, end):
            return None
        if surface in self.reviewed:
            value, who = self.reviewed[surface]
            return surface, value, OVERRIDE_SCORE, "team_comp_reviewed_override", "|".join(who), start, end
        got = None if self.is_equipment(text, start, end) else self.rebuilt(surface)
        return (surface, got[0], SLOT_SCORE, "team_comp_requery", "|".join(got[1]), start, end) if got else None

    def hints(self, text: str | None, most: int = 2) -> list[str]:
        """Surfaces worth asking for: reviewed ones first (each time they occur), then pairs that can be rebuilt."""
        text = text or ""
        spans = [(s, m.start(), m.start() + len(s)) for s in self.reviewed for m in re.finditer(f"(?={re.escape(s)})", text)]
        taken = [x for x in spans if self.beside_team(text, *x[1:])]
        out = [s for s, _, _ in taken][:most]
        pairs = ((p.group()[i : i + 2], p.start() + i) for p in PIECE.finditer(text) for i in range(len(p.group()) - 1))
        for pair, at in pairs:
            if len(out) >= most:
                break
            clear = all(at >= e or at + 2 <= s for _, s, e in taken)
            if "队" not in pair and pair not in out and clear and self.beside_team(text, at, at + 2) and not self.is_equipment(text, at, at + 2) and self.rebuilt(pair):
                out.append(pair)
        return out


def parse_teams(cues: DataFrame, team: Team, nicknames: DataFrame) -> DataFrame:
    """Members named in cues(doc_id, cue_index, text) that speak of a team, once each.

    nicknames(surface, canonical) are found by containment. Single characters come first, then nicknames
    from the longest; `ord` is that order. A cue without a trigger word gives no row."""
    spoken = cues.select("doc_id", "cue_index", "text").filter(F.col("text").rlike("|".join(TRIGGERS)))

    @F.pandas_udf("array<struct<alias: string, canonical: string>>")
    def members(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: [{"alias": a, "canonical": c} for a, c in team.members(t)])

    single = spoken.select("doc_id", "cue_index", F.posexplode(members("text")).alias("_k", "m")).select("doc_id", "cue_index", "m.*", F.lit(0).alias("_g"), "_k")
    found = containment_spans(spoken, nicknames.select("surface").distinct()).join(nicknames, "surface")
    nick = found.select("doc_id", "cue_index", F.col("surface").alias("alias"), "canonical", F.lit(1).alias("_g"), (-F.length("surface")).alias("_k"))
    order = F.struct("_g", "_k", "alias")
    d = single.unionByName(nick).groupBy("doc_id", "cue_index", "canonical").agg(F.min_by("alias", order).alias("alias"), F.min(order).alias("_o"))
    return d.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "cue_index").orderBy("_o", "canonical"))).drop("_o")


def team_hints(cues: DataFrame, team: Team, most: int = 2) -> DataFrame:
    @F.pandas_udf("array<string>")
    def hints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: team.hints(t, most))

    return cues.select("doc_id", "cue_index", F.posexplode(hints("text")).alias("ord", "surface"))


def team_repairs(requests: DataFrame, team: Team) -> DataFrame:
    """requests(..., text, suspect_surface) with the repair's columns; rows without a repair go."""

    @F.pandas_udf(REPAIR)
    def repairs(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in REPAIR.split(", ")]
        for texts, surfaces in parts:
            rows = [team.repair(t, s) or (None,) * len(names) for t, s in zip(texts, surfaces, strict=True)]
            yield pd.DataFrame(rows, columns=names).astype({"start_char": "Int32", "end_char": "Int32"})

    d = requests.withColumn("_m", repairs("text", "suspect_surface")).filter("_m.value IS NOT NULL")
    return d.select(*requests.columns, "_m.*").withColumn("category", F.lit("team_comp_alias"))
