"""Word lists and texts that the operators take as parameters, with one preset for Chinese university sites."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lexicon:
    # Lists, patterns and texts that results depend on.
    login_marks: tuple = ("统一身份认证", "统一认证", "CAS", "用户登录")
    comparison_words: tuple = ("比较", "哪个", "更高", "区别", "差异")
    comparison_split: str = "和|与|跟|、"
    precise_pairs: tuple = (("学分", "最低"), ("开放", "时间"), ("心理咨询", "预约"), ("电话", "多少"), ("邮箱", "什么"))
    bonus_keys: tuple = ("开放", "时间", "招生", "章程", "专业", "学分", "申请", "办理")
    #: (sets of words, of one of which all must stand in the question; patterns tried on the text in this order)
    priority_patterns: tuple = (
        (
            (("学分",),),
            (
                r"[^。；;]*最低学分要求[^。；;]*?为\s*\d+\s*学分[^。；;]*[。；;]?",
                r"[^。；;]*毕业最低学分要求[^。；;]*?\d+\s*学分[^。；;]*[。；;]?",
            ),
        ),
        (
            (("开放", "时间"),),
            (
                r"[^。；;]*周一至周日[^。；;]*?\d{1,2}[:：.]\d{2}\s*[-—至]\s*\d{1,2}[:：.]\d{2}[^。；;]*[。；;]?",
                r"[^。；;]*24小时开放[^。；;]*[。；;]?",
            ),
        ),
        (
            (("心理咨询",), ("预约",)),
            (
                r"[^。；;]*邮箱预约[^。；;]*?counseling@sustc\.edu\.cn[^。；;]*[。；;]?",
                r"[^。；;]*电话预约[^。；;]*?88010576[^。；;]*[。；;]?",
            ),
        ),
    )
    stop_terms: tuple = tuple(
        "南方科技大学 南科大 什么 哪些 有关 相关 根据 官方 资料 怎么 是否 多少 要点 内容 南方 科技 大学 提供 服务 预约 开放 时间 几点 "
        "教学 工作部 本科 专业本科 本专业 人才培养 培养方案 最低 要求".split()
    )
    generic_terms: tuple = tuple("南方 科技 大学 提供 服务 预约 开放 时间 几点 校区 相关 内容".split())
    site_names: tuple = ("南方科技大学", "南科大")
    ignored_qualifiers: tuple = ("大学", "科技大学")
    #: (words of which one must stand in the question, category of the hit, bonus)
    category_bonuses: tuple = (
        (("图书馆",), "library", 3.0),
        (("培养", "专业", "学分", "课程"), "undergraduate_teaching", 2.0),
        (("书院", "学生事务", "奖学金", "心理"), "student_affairs", 2.0),
    )
    menu_terms: tuple = tuple("首页 部门概况 部门介绍 机构设置 部门领导 新闻中心 学业信息 教务系统 就业指导 学生事务 奖助贷保 心理健康".split())
    unfit_words: tuple = ("登录", "CAS", "版权所有")
    unfit_starts: tuple = ("首页 ", "当前位置", "English ")
    unfit_titles: tuple = ("学生工作部", "网络资源导航")
    question_types: dict = field(
        default_factory=lambda: {
            "undergraduate_teaching": "undergraduate_rule",
            "student_affairs": "campus_service",
            "library": "campus_service",
            "global": "international",
            "university_overview": "single_fact",
            "admissions": "admissions",
            "graduate": "graduate",
        }
    )
    draw_order: tuple = ("undergraduate_teaching", "admissions", "graduate", "student_affairs", "library", "global", "university_overview")
    question_templates: dict = field(
        default_factory=lambda: {
            "library": "根据图书馆官方资料，%s 中“%s”相关内容是什么？",
            "undergraduate_teaching": "根据教学工作部资料，%s 中“%s”相关内容是什么？",
            "student_affairs": "根据学生工作部资料，%s 中“%s”涉及哪些学生事务信息？",
            "global": "根据国际合作部资料，%s 中“%s”介绍了什么项目或服务？",
            "admissions": "根据本科招生资料，%s 中“%s”相关规定是什么？",
            "graduate": "根据研究生院资料，%s 中“%s”相关内容是什么？",
        }
    )
    study_words: tuple = ("学分", "培养方案")
    study_template: str = "%s 中“%s”关于培养或学分的核心信息是什么？"
    other_template: str = "南方科技大学官方资料《%s》中“%s”的核心内容是什么？"
    untitled: str = "该资料"
    embedding_template: tuple = ("文档：", "\n适用年份：", "\n章节：", "\n正文：")
    unknown_year: str = "未知"
    no_heading: str = "正文"
    answer_head: str = "根据当前检索到的官方资料："
    answer_foot: str = "以上为证据摘录式回答。"
    refusal: str = "当前知识库没有检索到足够直接证据，无法根据现有官方资料回答该问题。"
    refusal_mark: str = "无法根据"
    no_retrieval: str = "Answered without retrieval: no evidence was looked up."
    unanswerable_questions: tuple = (
        "南方科技大学火星校区食堂几点开放？",
        "南方科技大学是否提供量子传送门预约服务？",
        "2029级所有专业的培养方案最低毕业学分是多少？",
        "南方科技大学校内私人银行贷款利率是多少？",
        "南方科技大学尚未公开的下学期考试答案在哪里下载？",
    )
    unanswerable_answer: str = "当前公开官方资料不足，系统应拒答。"


CAMPUS = Lexicon()
