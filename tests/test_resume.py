"""Records of resumes."""

from __future__ import annotations

from jobweave.operators.resume import find_name, months_of, parse_profile, parse_profiles

FULL = """张  晨
智能体工程师 | 大模型应用开发工程师
13800138000 | zhangchen@example.com | 武汉

教育经历
湖北大学 计算机科学与技术 本科 2022.09–2026.06

实习经历
示例科技有限公司 大模型应用开发实习生 2025.06–2025.12

项目经历
1. 企业知识库智能问答系统 | LangChain、Milvus
负责 RAG 检索、重排与评测。
2. 多智能体工作流平台 | LangGraph、FastAPI
完成智能体状态编排与工具调用。
3. 岗位能力分析系统 | Java、Spring Boot、MySQL
完成数据服务和接口开发。

专业技能
Java、Spring Boot、MySQL、Redis、Python、FastAPI、LangChain、LangGraph、Milvus、Docker
"""
DASHED = """张晨
项目经历
职途智配——岗位洞察与人岗匹配多智能体系统
2025.10-2026.05
技术栈: Java、Spring Boot、MySQL
负责招聘 JD 批量导入、岗位技能抽取、候选人画像与匹配报告生成。

教育经历
湖北大学 计算机科学与技术 本科 2022.09-2026.06
"""
INTERNS = """李悦
教育经历
2022.09-2026.06
中南财经政法大学 · 信息管理与信息系统
本科
主修概率论与数理统计、数据库原理、数据挖掘、运筹学、管理信息系统

实习经历
2025.07-2025.12
澄海零售科技(虚构) · 数据分析实习生
广州
基于 MySQL 与 Python 重构门店经营日报，统一 GMV 口径。

2025.01-2025.04
星图出行研究中心(虚构) · 商业分析实习生
深圳
建立会员 RFM 分群模型并结合 K-Means 识别 5 类客群。

专业技能
SQL、Python、MySQL、K-Means、Tableau
"""


def test_full_resume():
    p = parse_profile(FULL)
    assert (p["name"], p["degree"], p["school"], p["major"], p["months"], p["years"], p["has_contact"]) == ("张晨", "本科", "湖北大学", "计算机科学与技术", 7, 0.58, True)
    assert [(r["name"], r["stack"]) for r in p["project_records"]] == [("企业知识库智能问答系统", "LangChain、Milvus"), ("多智能体工作流平台", "LangGraph、FastAPI"), ("岗位能力分析系统", "Java、Spring Boot、MySQL")]
    assert p["project_records"][0]["description"] == "负责 RAG 检索、重排与评测。" and p["rate"] >= 90
    assert p["experience_records"] == [{"company": "示例科技有限公司", "role": "大模型应用开发实习生", "period": "2025.06–2025.12", "intern": True, "description": ""}]
    assert len(p["skills"]) == 10 and p["skill_records"][0]["score"] == 0.98
    assert p["education_records"] == [{"school": "湖北大学", "degree": "本科", "major": "计算机科学与技术", "period": "2022.09–2026.06"}]


def test_dates_and_schools_are_no_projects():
    p = parse_profile(DASHED)
    (r,) = p["project_records"]
    assert r == {"name": "职途智配——岗位洞察与人岗匹配多智能体系统", "stack": "Java、Spring Boot、MySQL", "description": "负责招聘 JD 批量导入、岗位技能抽取、候选人画像与匹配报告生成。"}


def test_internships_apart_from_courses():
    p = parse_profile(INTERNS, known=("RFM", "Go"))
    assert p["projects"] == 0 and p["name"] == "李悦"
    assert [(r["company"], r["role"], r["period"], r["intern"]) for r in p["experience_records"]] == [
        ("澄海零售科技(虚构)", "数据分析实习生", "2025.07-2025.12", True), ("星图出行研究中心(虚构)", "商业分析实习生", "2025.01-2025.04", True)
    ]
    assert "RFM" in p["experience_records"][1]["description"] and "广州" in p["experience_records"][0]["description"]
    assert p["education_records"] == [{"school": "中南财经政法大学", "degree": "本科", "major": "信息管理与信息系统", "period": "2022.09-2026.06"}]
    assert {r["skill"]: r["score"] for r in p["skill_records"]}["RFM"] == 0.86 and "Go" not in p["skills"]


def test_years_need_the_word_experience():
    assert parse_profile("2019年毕业于某大学")["years"] == 0.0 and parse_profile("2021年加入")["years"] == 0.0
    assert parse_profile("我有5年以上开发经验")["years"] == 5.0 and parse_profile("3年6个月工作经验")["years"] == 3.5 and parse_profile("7 years of backend experience")["years"] == 7.0
    assert months_of(["Jan 2020 - Mar 2020", "2020.02-2020.05", "2019.12 至今"], (2020, 6)) == 7


def test_names():
    assert find_name(["个人简介", "智能体工程师", "王小明"]) == "王小明" and find_name(["姓 名：欧阳 明"]) == "欧阳明" and find_name(["x"] * 9 + ["王小明"]) is None
    assert find_name(["智能体工程师", "专业技能", "Java"], "智能体工程师测试简历_张晨.docx") == "张晨" and find_name(["Mary Ann Lee"]) == "Mary Ann Lee" and find_name([]) is None


def test_profiles_by_file_name(spark):
    df = spark.createDataFrame([(1, "工程师\n专业技能\nJava、Go", "简历_张晨.docx"), (2, " ", "a"), (3, None, "b"), (4, FULL, None), (4, FULL, None)], "id int, text string, file string")
    got = parse_profiles(df, "id", "text", file_col="file").collect()
    assert sorted((r["id"], r["name"]) for r in got) == [(1, "张晨"), (4, "张晨"), (4, "张晨")]
    assert parse_profiles(df.limit(0), "id", "text").count() == 0
