"""Word lists and patterns of type detection and of the Chinese toolkit.

Patterns are written so that Java's and RE2's engines read them alike.
"""

from __future__ import annotations

# Keywords of technical texts.
TECHNICAL = (
    "函数 方法 类 接口 API 算法 数据结构 数据库 服务器 配置 部署 测试 代码 编程 开发 框架 库 模块 "
    "Python Java JavaScript C++ HTML CSS SQL Git Docker Kubernetes Linux 系统 网络 安全 性能 "
    "def class import function method object string array list dict loop condition variable"
).split()

# Keywords of academic texts.
ACADEMIC = (
    "研究 分析 实验 方法 结果 结论 讨论 理论 模型 假设 验证 数据 统计 显著 相关 影响 因素 "
    "参考文献 摘要 关键词 引言 方法论 实证 定量 定性 样本 变量 指标 测量 评估 比较 对比 差异 "
    "因此 所以 由于 基于 根据 通过 采用 应用"
).split()

# Keywords of news.
NEWS = (
    "记者 报道 采访 发布 宣布 举行 召开 出席 参加 政府 部门 官员 领导 市民 群众 社会 公众 "
    "今天 昨天 明天 今年 去年 明年 近日 日前 据 表示 指出 强调 透露 介绍 说明 解释 "
    "消息 新闻 事件 情况 问题 措施 政策 决定"
).split()

# Keywords of novels: descriptions, expressions, moods, looks, characters, speech, time, comparisons,
# actions, thoughts, scenes, and what web novels are about.
NOVEL = (
    "心中 眼中 脸上 手中 身边 面前 背后 心里 眼里 怀中 耳边 唇边 眉头 眼角 嘴角 指尖 掌心 胸口 肩膀 "
    "笑容 微笑 苦笑 冷笑 轻笑 大笑 皱眉 蹙眉 点头 摇头 叹息 叹气 深呼吸 沉默 无语 哽咽 流泪 哭泣 "
    "温柔 冷漠 愤怒 喜悦 悲伤 恐惧 惊讶 疑惑 紧张 兴奋 失望 绝望 希望 欣喜 忧伤 痛苦 快乐 满足 不安 焦虑 "
    "美丽 漂亮 英俊 帅气 可爱 清秀 俊美 绝色 倾城 出众 优雅 高贵 神秘 魅力 迷人 动人 醉人 惊艳 "
    "强大 弱小 勇敢 胆怯 聪明 愚蠢 善良 邪恶 单纯 复杂 天真 成熟 冷静 冲动 理智 感性 坚强 脆弱 "
    "她说 他说 我说 说道 道 回答 询问 低语 轻声 大声 喃喃 呢喃 嘀咕 嘟囔 开口 启唇 张嘴 闭嘴 言道 "
    "突然 忽然 瞬间 片刻 许久 良久 半晌 刹那 顷刻 霎时 一瞬 转眼 眨眼 不久 稍后 随即 接着 然后 紧接着 "
    "宛如 仿佛 好似 犹如 就像 似乎 看起来 听起来 感觉像 如同 恰似 正如 好比 宛若 形如 状如 "
    "凝视 注视 端详 打量 扫视 环顾 回眸 侧目 瞥见 窥视 踱步 漫步 疾走 奔跑 冲向 走向 靠近 远离 转身 回头 "
    "伸手 抬手 挥手 摆手 握拳 松手 抚摸 轻抚 拥抱 推开 "
    "思考 思索 沉思 深思 琢磨 考虑 犹豫 迟疑 决定 下定决心 恍然 明白 理解 困惑 疑惑 担心 担忧 放心 安心 "
    "房间 卧室 客厅 书房 厨房 花园 庭院 阳台 窗边 门口 街道 小巷 广场 公园 咖啡厅 餐厅 学校 办公室 "
    "系统 任务 升级 等级 经验 技能 属性 装备 道具 背包 修为 境界 功法 武技 灵力 法力 真气 内力 丹药 宝物 "
    "师父 师兄 师姐 长老 宗主 掌门 弟子 门派 宗门 家族"
).split()

# Patterns of code.
CODE = [
    r"def\s+\w+\s*\(",
    r"class\s+\w+\s*\(",
    r"import\s+\w+",
    r"from\s+\w+\s+import",
    r"```[a-zA-Z]*\n",
    r"`[^`]+`",
    r"\w+\.\w+\(",
    r"=\s*[\"'][^\"']*[\"']",
    r"\{\s*\w+\s*:\s*\w+\s*\}",
    r"\[\s*\w+\s*,\s*\w+\s*\]",
]

#: What a text must hold for each of these patterns to match.
CODE_NEEDS = ["def", "class", "import", "import", "```", "`", "(", "=", "{", "["]

# Patterns of dialogue, lines anchored.
DIALOGUE = [
    r'"[^\n]*?"',
    r"「[^\n]*?」",
    r"『[^\n]*?』",
    r"(?m)^\s*[A-Z一-龥]+\s*[：:]\s*",
    r"(?m)^\s*\d+\.\s*[A-Z一-龥]+\s*[：:]\s*",
]

#: Characters of which a text must hold one for each of these patterns to match.
DIALOGUE_NEEDS = ['"', "「", "『", "：:", "：:"]

# Patterns of narration: thought, movement, expression, time.
NARRATION = [
    "心[中里]想[着道]?",
    "[他她我]的心[中里]",
    "暗自[想说]",
    "[想觉]得",
    "内心[的]?[想说]",
    "[他她我][轻慢急缓]?[走跑]",
    "[转回]身[向朝]?",
    "[伸抬挥]手",
    "[点摇][了着]?头",
    "[皱蹙][了着]?眉",
    "[闭合睁]着?眼",
    "[微苦冷轻][笑道说]",
    "脸上[露浮现带][出着]",
    "眼[中里]闪[过着烁]",
    "[温冷]柔[的]?[笑容声音]",
    "[突忽][然而]",
    "[片瞬刹][刻间那]",
    "[不一过]久",
    "[随紧接]即",
]
PRONOUN = "[他她我][们]?[的]?"

# Words that mark a turn of a narrative, markers of discourse and expressions of time.
TRANSITIONS = (
    "后来 接着 然后 随后 接下来 此时 这时 那时 突然 忽然 瞬间 刹那 顷刻 片刻 不久 "
    "因此 所以 但是 可是 然而 不过 虽然 尽管 另外 此外 而且 并且 同时 与此同时 "
    "在另一边 另一方面 回到 转眼 话说 说起 提到 关于 至于"
).split()
MARKERS = "首先 其次 再次 最后 总之 综上所述 第一 第二 第三 最后一点 一方面 另一方面 总的来说 换句话说".split()
TIMES = [r"\d+年", r"\d+月", r"\d+日", r"\d+点", r"\d+分", *"早上 中午 下午 晚上 深夜 春天 夏天 秋天 冬天 昨天 今天 明天 后天".split()]

# Patterns of spoken passages, the words spoken or their speaker in group 1.
SPOKEN = [r'["]([^"]*?)["]', r"[']([^']*?)[']", "「([^」]*?)」", "『([^』]*?)』", r'([^："]*?)说[：:]["]', r'([^："]*?)道[：:]["]']

# Chinese punctuation.
PUNCTUATION = "。！？；：，、（）【】《》〈〉「」『』〔〕［］｛｝…·～￥％"

# Weights of parts of speech of keywords; other parts weigh 1.
POS_WEIGHTS = {"n": 1.2, "nr": 1.5, "ns": 1.3, "nt": 1.4, "nw": 1.1, "nz": 1.2, "v": 1.0, "vd": 0.9, "vn": 1.1, "a": 0.8, "ad": 0.7, "an": 0.9, "l": 1.3, "s": 1.1, "f": 0.9, "eng": 1.2}
