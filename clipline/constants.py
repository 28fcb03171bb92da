"""Fixed values of the data model: word lists, labels, presets, templates and thresholds."""

# Segment types, in the order that decides ties.
SEGMENT_TYPES = ["opening", "highlight", "transition", "effect", "closing"]
UNCLASSIFIED = "unclassified"

# Words that point to a segment type when they occur in on-screen text.
OPENING_WORDS = [
    "start", "opening", "intro", "begin", "title", "logo", "episode", "vol", "chapter", "第", "集", "片头",
    "开幕", "开始", "前方", "前排", "第一", "预告", "开篇", "序章", "登场", "出场", "序幕", "背景介绍",
    "前情提要", "播出"]
HIGHLIGHT_WORDS = [
    "battle", "fight", "explosion", "climax", "燃", "爆", "绝了", "高能", "神", "帅", "厉害", "卧槽", "牛",
    "炸", "精彩", "超燃", "名场面", "高光", "对决", "激战", "反转", "真相", "高峰", "飙升", "全场最佳", "高潮"]
CLOSING_WORDS = [
    "end", "closing", "outro", "credits", "goodbye", "完结", "撒花", "再见", "结束", "辛苦", "下期", "期待",
    "谢幕", "片尾", "彩蛋", "to be continued", "see you", "告别", "落幕", "尾声", "终章", "感谢观看", "谢谢",
    "敬请期待", "下集"]
TRANSITION_WORDS = [
    "later", "meanwhile", "elsewhere", "之后", "同时", "另一边", "时间跳转", "回想", "回忆", "切换", "转场",
    "闪回", "倒叙", "插叙", "画面一转", "镜头切换"]

# Sentiment words.
POSITIVE_WORDS = ["燃", "炸", "绝了", "高能", "神", "帅", "厉害", "精彩", "期待"]
NEGATIVE_WORDS = ["完结", "再见", "结束"]

# Fields of a preset and the presets per video type, in label order.
PRESET_FIELDS = [
    "opening_pct", "closing_pct", "energy_mult", "cut_mult", "ocr_w", "audio_w", "yolo_w", "portrait_weight",
    "motion_tolerance"]
PRESETS = {
    "commercial": (0.15, 0.20, 1.2, 1.5, 0.8, 0.7, 0.6, 0.4, 0.7),
    "gaming": (0.05, 0.10, 2.0, 3.0, 0.4, 0.8, 0.9, 0.4, 3.0),
    "lecture": (0.20, 0.10, 0.8, 0.3, 1.3, 1.0, 0.6, 0.9, 0.3),
    "film_tv": (0.12, 0.18, 1.8, 1.0, 0.7, 0.9, 0.8, 0.8, 1.0),
    "music": (0.10, 0.25, 1.5, 0.5, 0.5, 1.4, 0.4, 0.3, 0.5),
    "anime": (0.08, 0.12, 2.5, 2.0, 0.5, 0.8, 0.9, 0.5, 2.5),
    "knowledge": (0.18, 0.12, 0.9, 0.4, 1.2, 0.9, 0.5, 0.6, 0.4),
    "sports": (0.08, 0.10, 2.2, 2.5, 0.3, 0.9, 1.0, 0.5, 3.0),
    "food": (0.12, 0.15, 1.0, 0.8, 0.7, 0.8, 0.9, 0.5, 0.8),
    "auto": (0.10, 0.18, 1.4, 1.2, 0.5, 0.8, 0.8, 0.4, 1.2),
    "short_drama": (0.08, 0.15, 2.0, 2.0, 0.6, 0.9, 0.8, 0.8, 1.5),
    "vlog": (0.12, 0.12, 1.5, 1.0, 0.6, 0.9, 0.8, 0.7, 1.0),
    "travel": (0.12, 0.15, 1.2, 1.0, 0.5, 0.8, 0.7, 0.3, 0.8),
    "agriculture": (0.15, 0.12, 0.7, 0.5, 1.0, 0.8, 0.8, 0.4, 0.6),
    "parenting": (0.12, 0.12, 1.0, 0.8, 0.9, 1.0, 0.7, 0.9, 0.7),
    "beauty_fashion": (0.10, 0.20, 1.2, 1.5, 0.6, 0.7, 0.8, 0.9, 0.8),
}
DEFAULT_VIDEO_TYPE = "vlog"

# Detector class groups.
VEHICLES = ["car", "truck", "bus", "motorcycle", "bicycle", "train", "boat", "aeroplane", "airplane"]
ANIMALS = ["bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe"]

# The nine zones of the composition grid, in tie order.
GRID_ZONES = [
    "top_left", "top", "top_right", "left", "center", "right", "bottom_left", "bottom", "bottom_right"]

# Colour zones in priority order.
COLOR_ZONES = ["white", "dark", "warm", "cool", "neutral"]

# Music and mood labels in rule order.
MUSIC_TYPES = ["激昂/紧张", "轻松/愉快", "舒缓/宁静", "悲伤/沉郁", "电子/科技", "节奏/打击"]
MUSIC_UNDECIDED = "无法判定"
MOODS = ["calm", "cheerful", "tense", "melancholy", "neutral", "energetic"]

# Palettes per colour tone.
PALETTES = {
    "warm": ["#ff6b35", "#f7c948", "#e8a87c"],
    "cool": ["#264653", "#2a9d8f", "#457b9d"],
    "contrast": ["#e63946", "#f1faee", "#1d3557"],
    "neutral": ["#6c757d", "#adb5bd", "#ced4da"],
}

# Hash tags used when a segment has neither speech nor text.
FALLBACK_WORDS = {
    "opening": "#片头", "highlight": "#高光", "transition": "#转场", "effect": "#特效", "closing": "#片尾"}

# Module and track vocabulary of the script schema.
MODULE_TYPES = ["title", "video_segment", "subtitle", "transition", "audio", "effect"]
TRACK_TYPES = ["video", "audio", "text", "effect"]
SOURCE_TYPES = ["video", "image", "text", "audio", "effect"]

# Rendering template per module type
# (label, description, structure type, layout, animation).
TYPE_TEMPLATES = {
    "title": ("片头标题", "视频开场标题片段", "opening", "center_text", "fade_in"),
    "video_segment": ("视频片段", "原始视频高光片段", "highlight", "full_screen", None),
    "subtitle": ("字幕叠加", "叠加字幕文字内容", "content", "bottom_text", "slide_up"),
    "transition": ("转场效果", "模块间过渡转场", "transition", "overlay", "crossfade"),
    "audio": ("音频段落", "背景音乐或音效段落", "content", "audio_only", None),
    "effect": ("视觉特效", "叠层特效或滤镜", "effect", "overlay", "scale_up"),
}

# Blueprint templates as (name, key, default duration, required).
TEMPLATES = {
    "product_review": [
        ("片头引语", "opening_intro", 3.0, False), ("开箱展示", "unboxing", 5.0, False),
        ("产品特写", "product_closeup", 6.0, True), ("使用场景", "usage_scene", 6.0, False),
        ("效果对比", "comparison", 4.0, True), ("优缺点总结", "pros_cons", 4.0, False), ("CTA", "cta", 3.0, False)],
    "shopping_live": [
        ("痛点引入", "pain_point", 3.0, False), ("商品特写", "product_closeup", 6.0, True),
        ("卖点口播", "selling_points", 8.0, True), ("使用演示", "demo", 6.0, False),
        ("价格锚点", "price_anchor", 2.0, False), ("限时福利", "urgency", 2.0, False), ("CTA", "cta", 3.0, False)],
    "talking_head": [
        ("话题引入", "topic_intro", 3.0, False), ("长时解说", "long_speech", 15.0, True),
        ("观点展开", "viewpoint", 5.0, False), ("案例佐证", "case_study", 5.0, False),
        ("金句收尾", "quote_ending", 3.0, False), ("CTA", "cta", 3.0, False)],
    "mashup": [
        ("节奏引爆", "rhythm_opener", 2.0, False), ("画面冲击 A", "impact_a", 4.0, True),
        ("内容过渡", "bridge", 2.0, False), ("画面冲击 B", "impact_b", 4.0, True),
        ("情绪堆叠", "emotion_build", 4.0, False), ("高潮爆发", "climax", 4.0, True), ("CTA", "cta", 2.0, False)],
    "none": [],
}

# Words that fit a module to a template slot.
SLOT_WORDS = {
    "opening_intro": ["片头", "标题卡", "开场", "引入"],
    "unboxing": ["开箱", "展示"],
    "product_closeup": ["产品特写", "商品展示", "产品展示", "特写"],
    "usage_scene": ["使用场景", "场景", "演示"],
    "comparison": ["对比", "效果对比"],
    "pros_cons": ["总结", "优缺点"],
    "cta": ["CTA", "行动号召", "购买", "关注", "点赞", "品牌露出"],
    "pain_point": ["痛点", "问题"],
    "selling_points": ["卖点", "口播", "台词金句"],
    "demo": ["演示", "使用"],
    "price_anchor": ["价格", "优惠", "福利"],
    "urgency": ["限时", "紧迫", "限量"],
    "topic_intro": ["话题", "引入"],
    "long_speech": ["解说", "讲解", "口播", "台词金句"],
    "viewpoint": ["观点", "论述"],
    "case_study": ["案例", "举例"],
    "quote_ending": ["金句", "收尾"],
    "rhythm_opener": ["节奏", "引爆"],
    "impact_a": ["动作高燃", "视觉爆发", "冲击"],
    "bridge": ["过渡", "转场", "硬切"],
    "impact_b": ["动作高燃", "视觉爆发", "冲击"],
    "emotion_build": ["情绪", "堆叠", "情绪峰值"],
    "climax": ["高潮爆发", "情绪峰值"],
}

# Material gaps as dimension -> (label, reason, accepted files).
GAP_DEFAULTS = {
    "shot_rhythm": ("镜头素材", "需要上传镜头素材", "video/*,image/*"),
    "subtitle_style": ("字幕样式", "需要上传字体或样式文件", ".ttf,.otf,.woff,.json"),
    "visual_style": ("画面包装", "需要上传模板或贴纸素材", "image/*,.psd,.json"),
    "transition": ("转场预设", "需要上传转场模板", ".json,.mp4"),
    "music_sync": ("BGM 音频", "需要上传背景音乐", "audio/*"),
    "narrative_structure": ("叙事素材", "需要上传补充脚本或视频", "video/*,image/*,.txt,.md"),
}

# Renderer names of transition types.
RENDER_TRANSITIONS = {
    "dissolve": "fade", "fade": "fade", "fade_in": "fade", "fade_out": "fade", "wipeleft": "wipeleft",
    "wiperight": "wiperight", "wipeup": "wipeup", "wipedown": "wipedown", "slideleft": "slideleft",
    "slideright": "slideright", "fadegrays": "fadegrays", "fadeblack": "fadeblack", "fadewhite": "fadewhite",
    "circlecrop": "circleclamp"}

# Allowed status changes as (from, to) pairs per kind of job.
STATUS_CHANGES = {
    "upload": [
        ("idle", "uploading"), ("error", "uploading"), ("done", "uploading"), ("uploading", "done"),
        ("uploading", "error"), ("done", "idle"), ("error", "idle")],
    "analysis": [
        ("idle", "processing"), ("failed", "processing"), ("completed", "processing"), ("processing", "completed"),
        ("processing", "failed"), ("completed", "idle"), ("failed", "idle")],
    "export": [
        ("idle", "queued"), ("failed", "queued"), ("idle", "processing"), ("queued", "processing"),
        ("processing", "completed"), ("processing", "failed"), ("queued", "failed"), ("completed", "idle"),
        ("failed", "idle")],
}
OPEN_STATUSES = ["pending", "processing", "queued"]
STALE_AFTER_S = 90

# Analysis stages in order.
STAGES = ["signal", "keyframes", "video_type", "ocr", "structure", "modules", "deconstruction"]

# Accepted uploads.
VIDEO_EXTENSIONS = [".mp4", ".mov", ".avi", ".webm", ".mkv", ".mpeg", ".mpg", ".m4v", ".3gp", ".3g2"]
MAX_UPLOAD_BYTES = 2 * 1024**3
