"""Life of short forms: generated from terms, mined in sentences, scored, reviewed, cleaned.

The word lists are parameters; their defaults are the fixed values of the zh-CN corpus."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.corpus import mined_confidence
from lexweave.operators.terms import clean_term

# Fixed values.
LINKERS = ("之", "的", "与", "及", "或")
BLOCKED_FIRST = ("之", "的", "与", "和", "及", "或", "一", "圣", "遗")
BLOCKED_LAST = ("之", "的", "与", "和", "及", "或", "套", "物")
SERIES = (
    "试作", "破魔", "讨龙", "铁蜂", "西风", "祭礼", "宗室", "暗巷",
    "匣里", "黑岩", "雨裁", "千岩", "贯月", "钢轮", "雪葬", "白影",
    "龙脊", "万国", "昭心", "忍冬", "天目", "桂木", "喜多", "竭泽",
    "原木", "森林", "公义", "静谧", "海渊", "沙中", "纯水", "烈阳",
    "决斗", "黑缨", "沐浴", "旅行", "冷刃", "黎明", "弹弓", "魔导",
    "翡玉", "甲级", "白铁", "银剑", "铁影", "飞天",
)
BASIC_SETS = ("冒险家", "幸运儿", "游医", "学士", "赌徒", "武人", "教官", "战狂", "奇迹", "守护", "勇士")
COMMON_WORDS = (
    "文字", "黄金", "原木", "森林", "暗影", "乐园", "深林", "花海", "水仙", "冰风", "辰砂", "余响", "饰金",
    "追忆", "乐团", "角斗", "染血", "奇迹", "守护", "勇士", "龙骨", "铁蜂", "冷刃", "弹弓", "银剑", "沙中", "纯水",
    "烈阳", "海渊", "静谧", "公义", "泡沫", "梦想", "假面", "面具", "旅人", "行者", "学者", "战士",
    "猎人", "射手", "剑士", "枪兵", "记录", "传说", "神话", "历史", "未来", "精华", "碎片",
    "套", "花", "羽", "沙", "杯", "冠", "弓", "剑", "刀", "枪", "斧", "锤", "杖",
    "大剑", "长枪", "单手", "双手", "法器", "刺", "盾", "矛",
)
MINED_BLOCKED = (
    "一套", "武器", "圣遗物", "试作", "破魔", "讨龙", "铁蜂",
    "西风", "祭礼", "宗室", "角斗", "流浪", "教官", "战狂",
    "学士", "赌徒", "奇迹", "冰风", "水仙", "花海", "乐园",
    "深林", "饰金", "辰砂", "来歆", "余响", "追忆",
)
AMBIGUOUS_PREFIXES = ("西风", "祭礼", "宗室", "暗巷", "雨裁", "匣里")
REVIEW_CHOICES = "手动确认: 保留(改primary) / 降级(维持secondary) / 删除"
PRIMARY, SECONDARY = "term_short_primary", "term_short_secondary"


@dataclass(frozen=True)
class AliasWords:
    """Lists and categories of the alias rules. `letter` is the class of which an alias needs one character."""

    linkers: tuple[str, ...] = LINKERS
    blocked_first: tuple[str, ...] = BLOCKED_FIRST
    blocked_last: tuple[str, ...] = BLOCKED_LAST
    blocked: tuple[str, ...] = SERIES
    basic: tuple[str, ...] = BASIC_SETS
    ambiguous: tuple[str, ...] = ()
    common: tuple[str, ...] = COMMON_WORDS
    letter: str = "[一-鿿]"
    set_mark: str = "套"
    joint: str = "之"
    set_category: str = "artifact"
    piece_category: str = "artifact_piece"
    weapon_category: str = "weapon"
    categories: tuple[str, ...] = field(default=("artifact", "artifact_piece", "weapon"))


#: The lists that mining uses in place of those of populating.
MINING = AliasWords(blocked=MINED_BLOCKED, ambiguous=AMBIGUOUS_PREFIXES)


def _among(c: Column, words: tuple[str, ...]) -> Column:
    return c.isin(*words) if words else F.lit(False)


def is_valid(alias: Column, words: AliasWords = AliasWords()) -> Column:
    """Two characters at least, no linker in it, no blocked end, not itself blocked, one letter of the class."""
    holds = F.lit(False)
    for x in words.linkers:
        holds = holds | F.contains(alias, F.lit(x))
    ends = _among(F.substring(alias, 1, 1), words.blocked_first) | _among(F.substring(alias, -1, 1), words.blocked_last)
    return (F.length(alias) >= 2) & ~_among(alias, words.blocked) & ~holds & ~ends & alias.rlike(words.letter)


def is_basic(term: Column, category: Column, words: AliasWords = AliasWords()) -> Column:
    named = F.lit(False)
    for x in words.basic:
        named = named | F.startswith(term, F.lit(x)) | F.endswith(term, F.lit(x))
    return category.isin(words.set_category, words.piece_category) & named


def _cuts(term: Column, most: Column, words: AliasWords) -> Column:
    """Valid suffixes of 3 and 2, then prefixes of 2 and 3 characters, none twice."""
    piece = lambda c, k: F.when((most >= k) & (F.length(term) >= k) & is_valid(c, words), c)
    every = F.array(*[piece(F.substring(term, -k, k), k) for k in (3, 2)], *[piece(F.substring(term, 1, k), k) for k in (2, 3)])
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def mined_candidates(terms: DataFrame, words: AliasWords = MINING) -> DataFrame:
    """terms(term, category) -> term, alias: valid short forms; of sets and their pieces the set forms too."""
    d = terms.select("term", "category", F.explode(_cuts(F.col("term"), F.lit(3), words)).alias("alias"))
    marked = F.col("category").isin(words.set_category, words.piece_category)
    sets = d.filter(marked).withColumn("alias", F.concat("alias", F.lit(words.set_mark)))
    return d.unionByName(sets).select("term", "alias").distinct()


def risk_flags(alias: Column, term: Column, owners: Column, words: AliasWords = AliasWords()) -> Column:
    """How the alias stands in its term, and whether it is ambiguous: flags joined by pipes."""
    place = F.when(F.endswith(term, alias), "unique_suffix").when(F.startswith(term, alias), "unique_prefix").otherwise("mid_substring")
    return F.concat_ws("|", place, F.when(owners > 1, "ambiguous_alias"), F.when(_among(alias, words.ambiguous), "ambiguous_prefix"))


def occurrences_in(sentences: DataFrame, aliases: DataFrame, broadcast_aliases: int = 100_000) -> DataFrame:
    """sentence_id, alias, first: each alias in each sentence that holds it, with its first place.

    Sentences are cut into the lengths that aliases have and joined by equality."""
    a = aliases.filter(F.length("alias") > 0).select("alias").distinct()
    used = a.groupBy(F.length("alias").alias("n")).agg(F.count("*").alias("k")).collect()  # a few numbers
    lengths = [r["n"] for r in used]
    c = F.col("_c")  # characters: a substring from far inside would walk the text again
    of = lambda n: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.struct(F.concat(*[F.get(c, i + k) for k in range(n)]).alias("alias"), i.alias("first"))))
    if not lengths:
        return sentences.select("sentence_id", F.lit("").alias("alias"), F.lit(0).alias("first")).limit(0)
    every = F.flatten(F.filter(F.array(*[of(n) for n in lengths]), lambda x: x.isNotNull()))
    at = sentences.select("sentence_id", F.split("sentence", "").alias("_c")).select("sentence_id", F.explode(every).alias("w")).select("sentence_id", "w.*")
    # the exploded side must never be the broadcast one, whatever its files' size suggests
    a = F.broadcast(a) if sum(r["k"] for r in used) <= broadcast_aliases else a.hint("merge")
    return at.join(a, "alias").groupBy("sentence_id", "alias").agg(F.min("first").alias("first"))


def evidence(sentences: DataFrame, aliases: DataFrame, examples: int = 5, around: int = 6, longest: int = 50) -> DataFrame:
    """alias, evidence, examples of sentences(sentence_id, sentence): how many hold it, and the first few places."""
    found = occurrences_in(sentences, aliases)
    counted = found.groupBy("alias").agg(F.count("*").alias("evidence"))
    # the first sentences of an alias are kept by each task before they are shuffled
    w = Window.partitionBy("alias").orderBy("sentence_id")
    first = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= examples).join(sentences.hint("merge"), "sentence_id")
    begin = F.greatest(F.lit(0), F.col("first") - around)
    end = F.least(F.length("sentence"), F.col("first") + F.length("alias") + around)
    snippet = F.substring(F.trim(F.substring(F.col("sentence"), begin + 1, end - begin)), F.lit(1), F.lit(longest))
    held = first.groupBy("alias").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", snippet.alias("s")))), lambda x: x["s"]).alias("examples"))
    return counted.join(held.hint("merge"), "alias")


def mined(sentences: DataFrame, terms: DataFrame, support: int = 2, words: AliasWords = MINING) -> DataFrame:
    """alias, term, evidence, owners, confidence, risk_flags, examples, review_status of the short forms of
    terms(term, category, seq) that at least `support` sentences hold; of several owners the first by seq."""
    pairs = mined_candidates(terms, words).join(terms.groupBy("term").agg(F.min("seq").alias("seq")).hint("merge"), "term")
    owners = pairs.groupBy("alias").agg(F.count("*").alias("owners"), F.min_by("term", F.struct("seq", "term")).alias("term"))
    d = owners.join(evidence(sentences, owners).filter(F.col("evidence") >= support).hint("merge"), "alias")
    confidence = F.round(mined_confidence(F.col("evidence"), F.col("owners"), F.endswith("term", "alias")), 2)
    return d.select("alias", "term", "evidence", "owners", confidence.alias("confidence"), risk_flags(F.col("alias"), F.col("term"), F.col("owners"), words).alias("risk_flags"), "examples", F.lit("pending").alias("review_status"))


# ---- populating a store --------------------------------------------------------------------


def _meaning(term: Column, words: AliasWords) -> Column:
    """What stands before the joint, if it is neither first nor last."""
    at = F.instr(term, words.joint)
    return F.when((at > 1) & (at < F.length(term)), F.substring(term, F.lit(1), at - 1))


def alias_score(alias: Column, term: Column, words: AliasWords = AliasWords()) -> Column:
    base, meaning = F.replace(alias, F.lit(words.set_mark), F.lit("")), _meaning(term, words)
    whole = (alias == meaning) | (alias == F.concat(meaning, F.lit(words.set_mark)))
    joint = F.when(meaning.isNull(), 0).when(whole, 15).when(base == meaning, 12).otherwise(0)
    place = F.when(F.endswith(term, alias), 10).when(F.endswith(term, base), 8).when(F.startswith(term, alias), 5).when(F.startswith(term, base), 3).otherwise(0)
    return joint + place + F.when(F.endswith(alias, F.lit(words.set_mark)), 5).otherwise(0) + F.when(F.length(alias) == 2, 3).when(F.length(alias) == 3, 1).otherwise(0)


def populated(terms: DataFrame, aliases: DataFrame, least: int = 4, words: AliasWords = AliasWords()) -> DataFrame:
    """term_id, category, alias, alias_type, is_new: the two best short forms of terms(term_id, term, category).

    is_new is false where the store has the alias already. Ties of the score keep the order in which
    forms are cut: suffixes before prefixes, set forms last."""
    d = terms.filter(_among(F.col("category"), words.categories) & (F.length("term") >= least))
    d = d.filter(~is_basic(F.col("term"), F.col("category"), words)).withColumn("t", clean_term(F.col("term"))).filter(F.length("t") >= 4)
    most = F.when((F.col("category") == words.weapon_category) & (F.length("t") == 4), 2).otherwise(3)
    d = d.withColumn("cuts", _cuts(F.col("t"), most, words)).filter(F.size("cuts") > 0)
    is_set = F.col("category") == words.set_category
    marked = F.transform("cuts", lambda x: F.concat(x, F.lit(words.set_mark)))
    d = d.withColumn("cuts", F.when(is_set, F.array_distinct(F.concat("cuts", marked))).otherwise(F.col("cuts")))
    ranked = F.transform("cuts", lambda x, i: F.struct((-alias_score(x, F.col("t"), words)).alias("score"), i.alias("i"), x.alias("alias")))
    best = F.when(F.size("cuts") <= 2, ranked).otherwise(F.slice(F.array_sort(ranked), F.lit(1), F.lit(2)))
    d = d.withColumn("best", best)
    ends = lambda x: F.endswith(x["alias"], F.lit(words.set_mark))
    bare = F.transform(F.filter("best", ends), lambda x: F.replace(x["alias"], F.lit(words.set_mark), F.lit("")))
    d = d.withColumn("bare", bare)
    d = d.withColumn("best", F.when(is_set & (F.size("bare") > 0), F.filter("best", lambda x: ends(x) | ~F.array_contains(F.col("bare"), x["alias"]))).otherwise(F.col("best")))
    top = F.array_min(F.transform("best", lambda x: F.struct(x["score"], x["i"])))["i"]
    d = d.withColumn("n", F.size("best")).withColumn("top", top)
    d = d.withColumn("starts", F.exists("best", lambda x: F.startswith(F.col("t"), F.replace(x["alias"], F.lit(words.set_mark), F.lit("")))))
    d = d.withColumn("stops", F.exists("best", lambda x: F.endswith(F.col("t"), F.replace(x["alias"], F.lit(words.set_mark), F.lit("")))))
    d = d.select("term_id", "category", "t", "n", "top", "starts", "stops", F.explode("best").alias("b")).select("*", "b.alias", "b.i")
    base, meaning = F.replace("alias", F.lit(words.set_mark), F.lit("")), _meaning(F.col("t"), words)
    weapon = F.col("category") == words.weapon_category
    series = weapon & _among(F.substring("t", 1, 2), words.blocked)
    primary = (
        F.when(series, F.endswith(F.col("t"), base))
        .when(F.col("category") == words.piece_category, False)
        .when(F.col("category") == words.set_category, F.endswith("alias", F.lit(words.set_mark)))
        .when(meaning.isNotNull(), (base == meaning) | (F.col("alias") == F.concat(meaning, F.lit(words.set_mark))))
        .when(weapon & (F.col("n") == 2) & F.col("starts") & F.col("stops"), F.startswith(F.col("t"), base))
        .otherwise(F.col("i") == F.col("top"))
    )
    dropped = series & ~F.endswith(F.col("t"), base) & (F.col("alias") == F.substring("t", 1, 2))
    d = d.filter(~dropped & (F.length("alias") >= 2))
    known = aliases.select("term_id", "alias", F.lit(False).alias("_new")).distinct()
    d = d.select("term_id", "category", "alias", F.when(primary, PRIMARY).otherwise(SECONDARY).alias("alias_type")).join(known, ["term_id", "alias"], "left")
    return d.select("term_id", "category", "alias", "alias_type", F.coalesce("_new", F.lit(True)).alias("is_new"))


def population_counts(found: DataFrame) -> DataFrame:
    """generated, skipped, primary, secondary of populated(), by category."""
    count = lambda c: F.count_if(c)
    new = F.col("is_new")
    return found.groupBy("category").agg(count(new).alias("generated"), count(~new).alias("skipped"), count(new & (F.col("alias_type") == PRIMARY)).alias("primary"), count(new & (F.col("alias_type") == SECONDARY)).alias("secondary"))


def approved(aliases: DataFrame, mark: str = "_draft") -> DataFrame:
    """aliases whose type ends in the mark, without it."""
    return aliases.withColumn("alias_type", F.when(F.endswith("alias_type", F.lit(mark)), F.replace("alias_type", F.lit(mark), F.lit(""))).otherwise(F.col("alias_type")))


# ---- review and cleaning -------------------------------------------------------------------


def routed(candidates: DataFrame, sure: float = 0.85) -> DataFrame:
    """candidates(review_status, risk_flags, confidence) with the status after review, kind and use of the alias.

    Pending ones that are ambiguous need context, sure ones are approved, others stay pending; no status is pending."""
    flags = F.coalesce("risk_flags", F.lit(""))
    ambiguous = F.contains(flags, F.lit("ambiguous_alias"))
    status = F.coalesce(F.nullif(F.trim("review_status"), F.lit("")), F.lit("pending"))
    after = F.when(status != "pending", status).when(ambiguous, "needs_context").when(F.coalesce("confidence", F.lit(0.0)) >= sure, "approved").otherwise("pending")
    kind = F.when(F.contains(flags, F.lit("normal_title_alias")), "normal_title_alias").when(ambiguous, "ambiguous_alias").otherwise("term_short_alias")
    return candidates.withColumn("review_status", after).withColumn("alias_kind", kind).withColumn("usage_policy", F.when(ambiguous, "needs_context").otherwise("context_only"))


def exported(candidates: DataFrame, sure: float = 0.85) -> DataFrame:
    """The routed candidates that are approved or need context."""
    return routed(candidates, sure).filter(F.col("review_status").isin("approved", "needs_context"))


def with_flag(flags: Column, flag: str) -> Column:
    """Sorted distinct flags with one more, joined by pipes."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_append(F.filter(F.split(F.coalesce(flags, F.lit("")), r"\|"), lambda x: x != ""), F.lit(flag)))), "|")


def cleaned(rows: DataFrame, words: AliasWords = AliasWords()) -> DataFrame:
    """rows(alias_surface, canonical_term, alias_kind, usage_policy, risk_flags) with kind, policy and flags after cleaning, and tier.

    Tier 1 is kept; 2 is secondary or demoted: ambiguous, common, or not the least of several primaries of
    its term; 3 is demoted for being ambiguous alone, for a reviewer."""
    primary = F.col("alias_kind") == PRIMARY
    of_term = rows.filter(primary).groupBy("canonical_term").agg(F.count("*").alias("_n"), F.min("alias_surface").alias("_least"))
    d = rows.join(of_term, "canonical_term", "left")
    flags = F.coalesce("risk_flags", F.lit(""))
    ambiguous, common = F.contains(flags, F.lit("ambiguous")), _among(F.col("alias_surface"), words.common)
    several = F.coalesce(F.col("_n") > 1, F.lit(False))
    kept = several & primary & (F.col("alias_surface") == F.col("_least"))
    secondary = F.contains("alias_kind", F.lit("secondary"))
    demoted = ~secondary & (ambiguous | common | (several & ~kept))
    tier = F.when(secondary, 2).when(demoted & ambiguous & ~common, 3).when(demoted, 2).otherwise(1)
    d = d.withColumn("_demoted", demoted).withColumn("tier", tier).withColumn("_flags", F.when(F.col("_demoted"), with_flag(F.col("risk_flags"), "needs_review")).otherwise(F.col("risk_flags")))
    kind = F.when(F.col("_demoted"), SECONDARY).otherwise(F.col("alias_kind"))
    policy = F.when(F.col("tier") > 1, "exact_context_only").otherwise(F.col("usage_policy"))
    return d.withColumn("usage_policy", policy).withColumn("alias_kind", kind).withColumn("risk_flags", F.col("_flags")).drop("_n", "_least", "_demoted", "_flags").select(*rows.columns, "tier")


def review_list(clean: DataFrame) -> DataFrame:
    """What a reviewer decides: the aliases of tier 3, with the reason and the choices."""
    return clean.filter("tier = 3").select("alias_surface", "canonical_term", F.col("risk_flags").alias("reason"), F.lit(REVIEW_CHOICES).alias("suggestion"))


def write_review_list(clean: DataFrame, path: str) -> None:
    review_list(clean).write.mode("overwrite").option("header", True).csv(path)
