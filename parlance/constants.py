"""Closed label sets, templates, the topic taxonomy and word lists.

Everything in this module is a fixed value that has to equal the published
definition of the data for results to be right. There is no logic here.
"""

# Turn roles.
ROLES = ("customer", "agent")

# Closed label sets.
SENTIMENT_LABELS = ("pos", "neu", "neg")
LANGUAGE_LABELS = ("en", "hi", "mixed")
EMPATHY_LABELS = ("empathetic", "neutral", "dismissive", "na")
INTENT_LABELS = (
    "complaint",
    "query",
    "acknowledgement",
    "urgency_request",
    "escalation_request",
    "resolution_confirmation",
    "thanks",
    "apology",
    "solution_offer",
    "status_update",
    "info_request",
    "other",
)

# Empathy label -> score; any other label has no score.
EMPATHY_SCORES = {"empathetic": 1.0, "neutral": 0.5, "dismissive": 0.0}

# Intents with which a customer closes a conversation.
CLOSING_INTENTS = ("resolution_confirmation", "thanks")

# Topic of a conversation whose opener is not in the taxonomy.
UNKNOWN_TOPIC = "unknown"

# Known words that general word lists miss.
DOMAIN_ALLOWLIST = (
    "fastag",
    "teleconsult",
    "esim",
    "upi",
    "sso",
    "webhooks",
    "broadband",
    "roaming",
    "porting",
    "wallet",
    "voucher",
    "coupon",
    "baare",
    "mein",
    "mujhe",
    "thoda",
    "jaldi",
    "abhi",
    "rahi",
    "raha",
    "hoon",
    "chahiye",
    "kindly",
)

# A word below this Zipf frequency counts as gibberish.
ZIPF_THRESHOLD = 1.0

# What a word token is.
WORD_PATTERN = r"[A-Za-z][A-Za-z'’/-]*"

# Opener templates (id, pattern with the slot as group 1), first match wins.
SLOT_TEMPLATES = (
    ("en_not_working", r"^Hello, my (.+) is not working as expected\.$"),
    ("en_need_help", r"^Hi, I need help with my (.+)\.$"),
    ("hi_app_crash", r"^App crash ho rahi hai while using (.+)\.$"),
    ("en_coupon", r"^Coupon isn.?t applying on checkout for the (.+)\.$"),
    ("hi_mujhe_help", r"^Mujhe (.+) ke baare mein help chahiye\.$"),
    ("en_charged_twice", r"^I was charged twice for my (.+)\.$"),
    ("en_upi_service", r"^UPI shows successful but I didn.?t get the service for (.+)\.$"),
    ("en_not_arrived", r"^The (.+) hasn.?t arrived yet\. Can you check\?$"),
)

# Openers without a slot (curly and ASCII apostrophe) and their template id.
NO_SLOT_OPENERS = (
    "I can’t log in. It says account locked.",
    "I can't log in. It says account locked.",
)
NO_SLOT_TEMPLATE = "<no_slot>"

# Topic categories (id, label, description).
CATEGORIES = (
    ("telecom_plans", "Telecom Plans & Packs",
     "Issues related to mobile data packs, 4G/5G upgrades, international/roaming plans, and SIM management."),
    ("broadband_connectivity", "Broadband & Connectivity",
     "Issues related to home or office broadband services, connection quality, and setup."),
    ("telecom_number_management", "Number & SIM Management",
     "Issues related to porting numbers, eSIM activation, and SIM-related changes."),
    ("payments_wallet", "Payments & Wallet",
     "Issues related to digital wallet, UPI transactions, FASTag, and payment failures."),
    ("billing_refunds", "Billing & Refunds",
     "Issues related to invoices, billing disputes, refunds, and credit card charges."),
    ("financial_products", "Financial Products",
     "Issues related to loans, mutual funds, savings accounts, and insurance products."),
    ("insurance_claims", "Insurance & Claims",
     "Issues related to filing, tracking, or resolving insurance claims."),
    ("orders_delivery", "Orders & Delivery",
     "Issues related to placing orders, delivery status, returns, and exchanges."),
    ("promotions_vouchers", "Promotions & Vouchers",
     "Issues related to coupons, promo codes, gift cards, vouchers, and partner offers."),
    ("membership_subscription", "Membership & Subscription",
     "Issues related to subscription plans, membership tiers, and prime or priority delivery benefits."),
    ("travel_transport", "Travel & Transport",
     "Issues related to booking or managing flights, hotels, buses, and cab rides."),
    ("healthcare_services", "Healthcare Services",
     "Issues related to teleconsultations, prescriptions, lab tests, and medical appointments."),
    ("learning_education", "Learning & Education",
     "Issues related to courses, assignments, exams, mock tests, certificates, and career tracks."),
    ("developer_platform", "Developer & Platform",
     "Issues related to APIs, webhooks, analytics, audit logs, reports, and workspace configuration."),
    ("account_auth", "Account & Authentication",
     "Issues related to login, account access, SSO, and account lockouts."),
)

# Slot -> category id.
SLOT_TO_CATEGORY = {
    "4G Pack": "telecom_plans",
    "5G Upgrade": "telecom_plans",
    "API": "developer_platform",
    "Analytics": "developer_platform",
    "Appointment": "healthcare_services",
    "Assignment": "learning_education",
    "Audit Logs": "developer_platform",
    "Billing": "billing_refunds",
    "Broadband": "broadband_connectivity",
    "Bus": "travel_transport",
    "Cab": "travel_transport",
    "Career Track": "learning_education",
    "Certificate": "learning_education",
    "Coupon": "promotions_vouchers",
    "Course": "learning_education",
    "Credit Card": "billing_refunds",
    "Exam": "learning_education",
    "Exchange": "orders_delivery",
    "FASTag": "payments_wallet",
    "Flight": "travel_transport",
    "Gift Card": "promotions_vouchers",
    "Hotel": "travel_transport",
    "Insurance": "financial_products",
    "Insurance Claim": "insurance_claims",
    "International Pack": "telecom_plans",
    "Lab Test": "healthcare_services",
    "Loan": "financial_products",
    "Membership": "membership_subscription",
    "Mock Test": "learning_education",
    "Mutual Fund": "financial_products",
    "Order": "orders_delivery",
    "Partner Offer": "promotions_vouchers",
    "Porting": "telecom_number_management",
    "Prescription": "healthcare_services",
    "Prime Delivery": "orders_delivery",
    "Priority Delivery": "orders_delivery",
    "Promo": "promotions_vouchers",
    "Refund": "billing_refunds",
    "Report": "developer_platform",
    "Return": "orders_delivery",
    "Roaming": "telecom_plans",
    "SSO": "account_auth",
    "Savings": "financial_products",
    "Subscription": "membership_subscription",
    "Teleconsult": "healthcare_services",
    "UPI": "payments_wallet",
    "Voucher": "promotions_vouchers",
    "Wallet": "payments_wallet",
    "Webhooks": "developer_platform",
    "Workspace": "developer_platform",
    "eSIM": "telecom_number_management",
}

# No-slot opener -> category id.
OPENER_TO_CATEGORY = {"I can't log in. It says account locked.": "account_auth"}

# Personal-data shapes and what replaces them, applied in this order.
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
CARD_PATTERN = r"\b(?:\d[ -]?){13,19}\b"
PHONE_PATTERN = r"\b\+?\d[\d\s().-]{7,}\d\b"
EMAIL_MARK = "[REDACTED_EMAIL]"
CARD_MARK = "[REDACTED_CARD]"
PHONE_MARK = "[REDACTED_PHONE]"

# Argument ranges and closed argument sets of the queries.
MAX_LIMIT = 100
MAX_K = 20
GROUP_KEYS = ("topic", "agent_name", "month", "language")
METRICS = ("count", "avg_sentiment", "avg_empathy", "escalation_rate", "resolution_rate")
LIST_ORDER_COLUMNS = (
    "start_ts",
    "end_ts",
    "customer_sentiment_overall",
    "turn_count",
    "escalation_flag",
    "resolution_flag",
    "agent_empathy_mean",
)
AGENT_SORT_COLUMNS = (
    "empathy_mean",
    "resolution_rate",
    "avg_customer_sentiment",
    "escalation_rate",
    "conv_count",
)

# Shares and statuses of answer scoring.
COVERAGE_PASS = 0.5
EVAL_STATUSES = ("pass", "partial", "fail")
