"""Word lists and rule tables."""

# Intents that always, or never, ask the knowledge base; words that make the others ask.
ALWAYS_SEARCH = ("query", "technical", "billing", "account", "order_status", "logistics", "refund", "invoice", "payment_issue", "account_security", "technical_login", "technical_crash")
NEVER_SEARCH = ("greeting", "feedback", "escalation", "human_handoff")
BUSINESS_WORDS = (
    "订单", "物流", "快递", "配送", "退款", "退货", "账单", "扣款", "支付", "发票", "账户", "账号", "登录", "密码", "验证码", "报错", "错误", "崩溃", "会员", "积分", "订阅",
    "order", "delivery", "shipping", "refund", "invoice", "payment", "account", "login", "error",
)

# Keywords of each intent, specific ones first, in order of preference.
SPECIFIC_PATTERNS = {
    "human_handoff": ("转人工", "人工客服", "找人工"),
    "order_status": ("订单状态", "发货了吗", "处理到哪", "order status"),
    "logistics": ("物流", "快递", "配送", "运单", "delivery", "shipping"),
    "refund": ("退款", "退货", "refund", "return"),
    "invoice": ("发票", "抬头", "税号", "invoice"),
    "payment_issue": ("重复扣款", "多扣", "支付失败", "扣费", "payment failed"),
    "account_security": ("被盗", "异常登录", "重置密码", "两步验证", "安全"),
    "technical_login": ("无法登录", "登录失败", "401", "验证码"),
    "technical_crash": ("崩溃", "闪退", "500", "报错", "crash"),
}
GENERIC_PATTERNS = {
    "escalation": ("投诉", "经理", "转人工", "supervisor"),
    "complaint": ("太差", "糟糕", "horrible", "等了很久"),
    "query": ("?", "？", "怎么", "什么", "status"),
    "request": ("帮我", "需要", "please", "help"),
    "greeting": ("你好", "嗨", "hello", "hi"),
    "billing": ("退款", "扣款", "发票", "refund"),
    "technical": ("崩溃", "报错", "error", "crash"),
    "account": ("密码", "邮箱", "账户", "password"),
}
# The eight lists of the rule that scores by shares of a list.
SHARE_PATTERNS = {
    "escalation": ("投诉", "经理", "转人工", "supervisor"),
    "complaint": ("太差", "糟糕", "horrible", "等了很久"),
    "query": ("?", "？", "怎么", "什么", "status"),
    "request": ("帮我", "需要", "please", "help"),
    "greeting": ("你好", "嗨", "hello", "hi"),
    "billing": ("退款", "扣款", "发票", "refund"),
    "technical": ("崩溃", "报错", "error", "crash", "500", "401"),
    "account": ("密码", "邮箱", "账户", "password"),
}
# Example messages of each intent.
TEMPLATES = {
    "query": ("我的订单状态是什么？", "如何重置密码？", "快递什么时候到？"),
    "complaint": ("等了好几个小时！", "服务太差了！", "一直没人处理！"),
    "request": ("帮我取消订单", "我需要修改地址", "请协助退款"),
    "greeting": ("你好", "嗨，有人吗", "早上好"),
    "escalation": ("我要投诉！", "转人工客服", "找你们经理"),
    "technical": ("应用一直崩溃", "无法登录", "出现500错误"),
    "billing": ("为什么扣了两次款？", "申请退款", "发票问题"),
    "account": ("修改邮箱", "注销账户", "更新个人信息"),
    "feedback": ("服务很棒！", "非常满意", "给个好评"),
    "order_status": ("我的订单现在是什么状态？", "订单有没有发货？", "订单处理到哪一步了？"),
    "logistics": ("快递什么时候到？", "物流一直不更新", "配送要多久？"),
    "refund": ("我要申请退款", "退货退款怎么处理？", "退款多久到账？"),
    "invoice": ("帮我开发票", "发票抬头怎么改？", "电子发票在哪里？"),
    "payment_issue": ("为什么重复扣款？", "支付失败怎么办？", "这个月多扣了钱"),
    "account_security": ("账户被盗了", "发现异常登录", "我要重置密码"),
    "technical_login": ("登录一直报401", "验证码收不到", "无法登录账号"),
    "technical_crash": ("应用一直崩溃", "页面报500错误", "系统闪退"),
    "human_handoff": ("转人工客服", "我要找人工", "请升级处理"),
}
GENERIC_INTENTS = ("query", "billing", "technical", "account", "escalation")
INTENT_GROUPS = {
    "order_status": "query",
    "logistics": "query",
    "refund": "billing",
    "invoice": "billing",
    "payment_issue": "billing",
    "account_security": "account",
    "technical_login": "technical",
    "technical_crash": "technical",
    "human_handoff": "escalation",
}

# Urgency words, most urgent level first.
URGENCY = {
    "critical": ("紧急", "emergency", "urgent", "asap", "立刻"),
    "high": ("今天", "马上", "尽快", "hurry", "now"),
    "medium": ("这周", "soon", "快点"),
}

# Words that speak for a domain when a message is routed.
TECHNICAL_WORDS = ("崩溃", "报错", "error", "crash", "无法登录", "登录失败", "500", "401", "验证码")
BILLING_WORDS = ("退款", "退货", "扣款", "发票", "账单", "支付", "订阅", "refund", "invoice", "多扣")
GENERAL_WORDS = ("订单", "物流", "快递", "配送", "会员", "积分", "咨询", "帮助")
ESCALATION_WORDS = ("转人工", "人工客服", "escalate", "specialist", "无法处理")

# Query rewrites, tried in this order.
REWRITES = {
    "退款": ("退货", "款项退回"),
    "多久": ("时效", "几个工作日"),
    "到账": ("退回原支付账户", "入账"),
    "支付": ("付款", "扣款"),
    "物流": ("配送", "快递"),
    "怎么": ("如何",),
    "取消": ("关闭", "停止"),
    "密码": ("登录凭证",),
    "积分": ("会员积分",),
    "401": ("未认证", "认证失败"),
    "403": ("无权限", "权限不足"),
    "500": ("服务器错误", "服务端内部错误"),
    "429": ("限流", "请求过多"),
}

# Greetings and words of the plainer gate.
GREETINGS = ("你好", "您好", "hi", "hello", "hey")
GATE_WORDS = ("退款", "订单", "登录", "报错")

# Words that call in a domain beside the intent.
TECHNICAL_CALLS = ("崩溃", "报错", "error", "crash", "无法登录", "登录失败", "500", "401")
BILLING_CALLS = ("退款", "扣款", "发票", "账单", "支付", "订阅", "refund", "invoice")
