"""Character classes and word lists of the Persian text rules."""

from __future__ import annotations

#: Java patterns for what the rules mean by word, space and digit characters: Java's own \\w, \\s and \\d are ASCII.
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x1f \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ARABIC = r"\u0600-\u06ff"
END = r"(?=\n?\z)"

ZWNJ, ZWJ = "\u200c", "\u200d"

# Tables that results must agree with.
CHARACTERS = {"ي": "ی", "ى": "ی", "ك": "ک", "ڪ": "ک", "ة": "ه", "ؤ": "و", "إ": "ا", "أ": "ا", "ٱ": "ا"}
DELETED = r"[\u064b-\u065f\u0670\u0640\u06d6-\u06ed]"
PERSIAN_DIGITS, ARABIC_DIGITS, ASCII_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"
PREFIXES = ("می", "نمی")
SUFFIXES = ("هایی", "های", "ها", "ترین", "تر")
STOPWORDS = ("در", "به", "از", "و", "با", "را", "برای")
INTENTS = ("transactional", "commercial", "informational", "navigational")
MARKERS = {
    "transactional": ("قیمت خرید", "ثبت نام", "ثبت\u200cنام", "خرید", "سفارش", "دانلود", "دریافت", "رزرو", "پرداخت"),
    "commercial": ("ارزان ترین", "ارزان\u200cترین", "بهترین", "مقایسه", "تخفیف", "قیمت", "ارزان", "گران", "فروشگاه", "نمایندگی", "فروش"),
    "informational": ("چگونه", "چطور", "آموزش", "راهنما", "معنی", "تعریف", "تفاوت", "فرق", "چیست", "کیست", "چرا", "بررسی", "نمونه", "مثال"),
    "navigational": ("ورود به سایت", "سایت رسمی", "پنل کاربری", "ورود", "لاگین"),
}
INSUFFICIENT_CORE = ("اینترنتی",)
ROLES = {"pillar": 3, "commercial": 2, "informational": 1, "other": 0}
STATUSES = {"known": 2, "estimated": 1, "unknown": 0}
UI_PHRASES = ("ثبت نظر", "نمایش بیشتر", "همه حقوق", "همه\u200c حقوق", "ورود", "ثبت\u200cنام", "ثبت نام", "سبد خرید", "جستجو", "پنل", "افزودن به", "بازگشت به بالا", "نظر شما با موفقیت")
NAV_WORDS = r"ورود|ثبت[{space}\u200c]?نام|سبد خرید|اپلیکیشن|دانلود|کپی\u200cرایت|Copyright".replace("{space}", SPACE)
SHOP_CUES = "خرید|محصول|قیمت|دسته\u200c?بند|کالا|ارسال|گارانتی|تومان|سبد|فروشگاه|برند"
LONGEST_WEB_SENTENCE = 220
#: Explanations of decisions on pages; the fields are named.
KEEP_TEXT = "برنده بر اساس معیار {decided_by}."
DIFFERENTIATE_TEXT = "نقش صفحه ({role}) با برنده ({winner_role}) فرق دارد؛ زاویه را جدا کنید، حذف نکنید."
RETARGET_TEXT = "نقش یکسان است ولی محتوا قابل توجه است ({words} کلمه ≥ {limit})؛ کیورد هدف را عوض کنید."
MERGE_TEXT = "نقش یکسان و محتوای کم ({words} < {limit})؛ ادغام/۳۰۱ به {winner} پیشنهاد می\u200cشود."
OVERRIDE_TEXT = "priority صفحهٔ {winner} را برنده کرد، در حالی که بر اساس سیگنال\u200cهای title/h1، نقش و لینک/حجم، صفحهٔ {signal} برنده می\u200cشد. اختیار انسان حفظ شد."
#: Explanations of skipped keywords; the status is quoted.
SKIP_TEXTS = {
    "empty_keyword_id": "شناسهٔ کلیدواژه خالی است.",
    "duplicate_keyword_id": "شناسهٔ کلیدواژه تکراری است؛ فقط نخستین نگه داشته شد.",
    "empty_keyword_text": "متن کلیدواژه خالی است.",
    "invalid_demand_status": "وضعیت حجم نامعتبر: '{status}'.",
    "demand_status_conflict": "با status=unknown نباید search_demand عددی باشد.",
    "missing_search_demand": "status شناخته‌شده/تخمینی نیاز به search_demand دارد.",
    "negative_search_demand": "search_demand منفی مجاز نیست (۰ با known معتبر است).",
    "no_content_tokens": "پس از حذف استاپ‌ورد توکن محتوایی نماند.",
    "only_intent_markers": "پس از حذف نشانگر نیت توکن موضوعی نماند.",
}
CLOSED_CLASS = tuple("در به از و با را که این آن یک یا تا بر برای است بود شد هست نیست روستایی توابع بخش شهرستان استان ایران انگلیسی زاده بازیکن فوتبال اهل شهر دهستان مرکز جمعیت کیلومتر واقع".split())
VERBS = ("است", "بود", "شد", "رفت", "آمد", "کرد", "نمود", "داشت", "هستند", "نیست", "باشند", "باشید")
UNITS = ("٪", "کیلو", "گرم", "متر", "سانتی", "میلی", "لیتر", "تومان", "ریال")
STRATA_QUOTAS = {"zwnj": 30, "plural_ha": 30, "ye_non_ezafe": 25, "no_ezafe_candidate": 25, "latin_brand": 20, "number_unit": 20}
KIND_OF_DOMAIN = {
    "wiki": ("fa.wikipedia.org",),
    "news": ("hamshahrionline.ir", "isna.ir", "khabaronline.ir"),
    "magazine": ("digiato.com", "tarafdari.com", "zoomit.ir"),
    "ecommerce": ("digikala.com", "blog.okala.com", "okala.com", "basalam.com", "emalls.ir", "torob.com", "modiseh.com"),
}
LEGACY_KINDS = {"wikipedia": "wiki", "fa.wikipedia": "wiki", "news_portal": "news", "blog_portal": "magazine", "shop_mag": "ecommerce", "shop_wiki_stub": "ecommerce"}
BLOCKED_DOMAINS = ("technolife.ir",)
OUTSIDE_LABELS = ("", "o", "other", "none", "null", "_", "-", "0", "false", "no")

#: Texts that NFC may change in a way that the later rules don't undo. Arabic vowel marks are deleted anyway and compose
#: with nothing but U+0653-0655.
NEEDS_NFC = r"[\p{M}&&[^\u064b-\u0652\u0656-\u065f\u0670\u06d6-\u06ed]]|[\u0340-\u0387\u0958-\u095f\u09dc-\u09df\u0a33-\u0a5e\u0b5c\u0b5d\u0f43-\u0fb9\u1100-\u11ff\u1f71-\u1fff\u2000\u2001\u2126-\u212b\u2329\u232a\u2adc\uf900-\ufaff\ufb1d-\ufb4e]|[\x{1d15e}-\x{1d1c0}\x{2f800}-\x{2fa1d}]"
