"""What a posting asks for: skills by canonical name, required and bonus, duties, scenarios, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.evidence import clean_phrase, grounded, match_form
from jobweave.functions.text import spaces
from jobweave.operators.governance import first_match
from jobweave.sources.scratch import spread

# Markers of duties, requirements and optional requirements.
DUTIES = ("负责", "参与", "建设", "设计", "开发", "搭建", "维护", "优化", "推进", "落地", "交付", "实现")
REQUIREMENTS = ("要求", "掌握", "熟悉", "精通", "具备", "优先", "加分", "熟练", "了解")
BONUS = ("优先", "加分", "熟悉者优先", "有经验者优先", "bonus", "preferred", "nice to have")
# Names of scenarios and what tells them.
SCENARIOS = (
    ("智能客服", ("智能客服", "客服机器人", "对话机器人", "语音对话机器人")), ("企业知识库", ("企业知识库", "知识库", "RAG问答", "检索问答")), ("推荐系统", ("推荐系统", "个性化推荐", "召回", "排序")),
    ("工业互联网", ("工业互联网", "设备状态", "工装", "装配", "传感器")), ("智慧城市", ("智慧城市", "城市治理")), ("金融风控", ("金融风控", "风险控制", "反欺诈")), ("教育智能化", ("教育智能", "学习分析", "教学")),
    ("数字孪生", ("数字孪生", "仿真")), ("实时数据仓库", ("实时数仓", "实时数据仓库", "实时分析", "流处理")), ("数据资产治理", ("数据治理", "数据资产", "指标体系", "数据质量")),
    ("电商经营分析", ("电商", "经营分析", "销售预测", "库存风险")), ("内容安全审核", ("内容审核", "图像内容审核", "OCR", "合规审核")),
)
# What is no skill, and words that decide level and stack here, in order.
COURSES = ("操作系统", "离散数学", "数据库原理与应用", "数据库原理", "计算机组成原理", "编译原理", "软件工程导论", "大学英语", "高等数学", "线性代数", "概率论", "数理统计", "专业英语")
NO_SKILL_ENDS = ("经验", "背景", "方向", "岗位", "职责", "内容", "描述", "项目", "经历", "证书", "课程", "专业", "论文")
ACTIONS = ("负责", "参与", "使用", "熟悉", "掌握", "了解", "能够", "具有", "进行", "完成", "搭建", "建设", "精通", "负责过", "协助", "主导", "独立")
SOFT_SKILLS = ("能力", "团队", "协作", "沟通", "责任", "抗压", "领导", "主动", "思维", "认真", "积极", "细心", "学习能力", "执行力", "适应力", "表达")
ROLE_NOISE = r"(?i)(招聘|急招|校招|社招|诚聘|高薪|双休|五险一金)"
LEVELS = (("高级", "高级|资深|专家|架构|5年以上|五年以上"), ("中级", "中级|3年以上|三年以上|3-5年|两年以上|2年以上"))
STACKS = (
    ("大模型应用", "大模型|rag|agent|langchain|prompt|mcp"), ("后端开发", "java|spring|微服务|restful|后端"), ("大数据", "flink|spark|hadoop|hive|数仓|数据仓库"), ("数据分析", "数据分析|tableau|power bi|经营分析|ab测试|a/b测试"),
    ("物联网", "物联网|嵌入式|mqtt|边缘|工业互联网"), ("智能系统", "视觉|机器人|智能系统|图像识别"), ("前端开发", "vue|react|typescript|前端"),
)

NO_SKILL_END = f"(?:{'|'.join(NO_SKILL_ENDS)})$"
NO_SKILL = "|".join((*ACTIONS, *SOFT_SKILLS))


def alias_form(value: Column) -> Column:
    """How aliases are compared: lower case without blanks, underscores and hyphens."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[\s_\-]+", "")


def plausible_skill(name: Column) -> Column:
    """A skill rather than a phrase, a soft skill or a course: 1 to 25 characters, no single letter but C."""
    text = F.trim(name)
    return (
        text.isNotNull() & F.length(text).between(1, 25) & ~F.regexp_replace(text, r"\s+", "").isin(*COURSES) & ~(text.rlike("^[A-Za-z]$") & (F.upper(text) != "C"))
        & ~text.rlike(NO_SKILL_END) & ~text.rlike(NO_SKILL)
    )


def canonical_names(values: DataFrame, value_col: str, names: DataFrame) -> DataFrame:
    """(value_col, canonical, how): each different value with its canonical name.

    ``names`` has (name, alias, rank). An equal alias decides, else the first alias (by rank,
    name, alias) of three or more characters that holds the value or is held by it, else the
    value itself. Values and aliases meet over runs of three characters: whichever is held by
    the other shares its own first run with it, so no value meets all aliases. Blank values
    give no row.
    """
    forms = values.where(F.trim(value_col) != "").select(F.col(value_col).alias("value"), alias_form(F.col(value_col)).alias("form")).distinct()
    known = names.where("alias is not null").select("name", alias_form(F.col("alias")).alias("alias"), "rank").where("alias <> ''")
    first = lambda: F.min(F.struct("rank", "name", "alias"))["name"]
    equal = known.groupBy("alias").agg(first().alias("equal"))
    joined = forms.join(equal, F.col("form") == F.col("alias"), "left").drop("alias")
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda k: F.substring(c, k, F.lit(3))))
    open_ = joined.where("equal is null and length(form) >= 3").select("value", "form")
    long_ = known.where("length(alias) >= 3")
    held = open_.select("value", "form", F.explode(runs(F.col("form"))).alias("run")).join(long_.select("name", "alias", "rank", F.substring("alias", 1, 3).alias("run")), "run")
    holds = open_.select("value", "form", F.substring("form", 1, 3).alias("run")).join(long_.select("name", "alias", "rank", F.explode(runs(F.col("alias"))).alias("run")), "run")
    part = held.unionByName(holds).where(F.contains("form", F.col("alias")) | F.contains("alias", F.col("form"))).groupBy("value").agg(first().alias("part"))
    how = F.when(F.col("equal").isNotNull(), "equal").when(F.col("part").isNotNull(), "part").otherwise("own")
    return joined.join(part, "value", "left").select(F.col("value").alias(value_col), F.coalesce("equal", "part", F.trim("value")).alias("canonical"), how.alias("how"))


def near(text: Column, name: Column, radius: int = 60) -> Column:
    """What stands around the first place of ``name`` in ``text``, both in match form; empty when it does not occur."""
    place = F.position(name, text)
    start = F.greatest(F.lit(1), place - radius)
    return F.when(place > 0, F.substring(text, start, place + F.length(name) + radius - start)).otherwise("")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(w.replace(" ", "") for w in words))


def skill_buckets(texts: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, skill, part): skills of each text, BONUS where a marker stands within 60 characters, else REQUIRED.

    ``found`` has (id_col, skill). A text whose skills are all optional has them required.
    """
    placed = found.where(plausible_skill(F.col("skill"))).select(id_col, "skill").distinct().join(texts.select(id_col, match_form(F.col(text_col)).alias("t")), id_col)
    marked = placed.select(id_col, "skill", _any(near(F.col("t"), match_form(F.col("skill"))), BONUS).alias("bonus"))
    mixed = F.max((~F.col("bonus")).cast("int")).over(Window.partitionBy(id_col))
    return marked.withColumn("mixed", mixed).select(id_col, "skill", F.when(F.col("bonus") & (F.col("mixed") == 1), "BONUS").otherwise("REQUIRED").alias("part"))


def duties(text: Column, title: Column, most: int = 6) -> Column:
    """Up to ``most`` different sentences of 8 to 120 characters that tell a duty and do not begin as a requirement; a general one where there is none."""
    parts = F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\n")), r"[。；;\n]|(?<=\.)\s+"), clean_phrase)
    kept = F.filter(parts, lambda s: F.length(s).between(8, 120) & _any(match_form(s), DUTIES) & ~F.regexp_replace(s, r"\s+", "").rlike("^(?:" + "|".join(REQUIREMENTS) + ")"))
    kept = F.slice(F.array_distinct(kept), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.concat(F.lit("完成"), title, F.lit("相关系统设计、开发、优化与交付"))))


def scenarios(text: Column, stack: Column, most: int = 6) -> Column:
    """Scenarios that a text tells by one of their words, in their order; one of the stack where there is none."""
    low = match_form(text)
    found = F.array_compact(F.array(*[F.when(low.rlike("|".join(w.lower() for w in words)), F.lit(name)) for name, words in SCENARIOS]))
    return F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(F.array(F.concat(stack, F.lit("业务场景"))))


def role_name(title: Column) -> Column:
    """Title without round brackets and advertising; a general name where nothing is left."""
    text = F.regexp_replace(F.coalesce(title, F.lit("")), r"[（(].*?[）)]", " ")
    return F.coalesce(F.nullif(spaces(F.regexp_replace(text, ROLE_NOISE, " ")), F.lit("")), F.lit("未命名岗位"))


def confidence(required: Column, told: Column, coverage: Column, risk: Column) -> Column:
    """Confidence of an extraction, between 0.55 and 0.99."""
    value = 0.72 + F.least(F.lit(0.14), required * 0.014) + F.when(told >= 2, 0.06).otherwise(0.0) + F.least(F.lit(0.06), coverage * 0.06) - F.least(F.lit(0.12), risk * 0.4)
    return F.round(F.greatest(F.lit(0.55), F.least(F.lit(0.99), value)) + 1e-9, 3)


def extract_postings(postings: DataFrame, found: DataFrame, id_col: str, title_col: str, text_col: str) -> DataFrame:
    """One row per posting: role, stack, level, duties, scenarios, required and bonus skills, coverage and confidence.

    ``found`` has (id_col, skill): what a dictionary finds in the texts. Only keys and skills
    are shuffled; texts stay with their rows. Null titles and texts count as empty.
    """
    buckets = skill_buckets(postings, found, id_col, text_col).groupBy(id_col).agg(*[F.sort_array(F.collect_set(F.when(F.col("part") == p, F.col("skill")))).alias(p.lower()) for p in ("REQUIRED", "BONUS")])
    seen = found.select(id_col, "skill").distinct().groupBy(id_col).agg(F.count(F.lit(1)).alias("evidence"))
    none = F.expr("cast(array() as array<string>)")
    text = F.coalesce(text_col, F.lit(""))
    whole = F.lower(F.concat(F.col("role"), F.lit("\n"), text))
    rows = spread(postings).withColumn("role", role_name(F.col(title_col))).withColumn("stack", first_match(whole, STACKS, "人工智能")).withColumn("level", first_match(whole, LEVELS, "初级"))
    rows = rows.select(id_col, "role", "stack", "level", duties(text, F.col("role")).alias("duties"), scenarios(text, F.col("stack")).alias("scenarios"))
    rows = rows.join(buckets, id_col, "left").join(seen, id_col, "left").withColumns({"required": F.coalesce("required", none), "bonus": F.coalesce("bonus", none)})
    coverage = F.when(F.coalesce("evidence", F.lit(0)) == 0, 0.0).otherwise(F.round((F.size("required") + F.size("bonus")) / F.col("evidence"), 3))
    rows = rows.withColumn("coverage", coverage)
    return rows.withColumn("confidence", confidence(F.size("required"), F.size("duties"), F.col("coverage"), F.lit(0.0))).drop("evidence")


def gate(claims: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """(first key, accepted, blocked): claimed items that the evidence holds, and those it does not."""
    known = facts.select(*keys).distinct().withColumn("known", F.lit(True))
    joined = claims.select(*keys).distinct().join(known, keys, "left")
    return joined.groupBy(keys[0]).agg(F.count("known").alias("accepted"), F.count_if(F.col("known").isNull()).alias("blocked"))


def grounded_share(df: DataFrame, key: str, phrase: Column, text: Column) -> DataFrame:
    """(key, phrases, grounded): of each key how many phrases stand in their texts."""
    return df.select(F.col(key), grounded(phrase, text).alias("g")).groupBy(key).agg(F.count(F.lit(1)).alias("phrases"), F.count_if("g").alias("grounded"))
