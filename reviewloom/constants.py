"""Fixed values that results depend on. Everything here is data, not logic."""

# Aspect lexicon, in scoring order.
ASPECT_KEYWORDS: dict[str, list[str]] = {
    "performa": [
        "cepat", "kencang", "ngebut", "lancar", "mulus", "sat set", "gaming",
        "render", "editing", "multitasking", "ram", "ssd", "prosesor", "vga",
        "gpu", "intel", "ryzen", "nvidia", "rtx", "lemot", "lag", "hang",
        "lelet", "loading", "booting", "koding", "docker", "berat", "panas",
        "overheat", "adem", "dingin", "kipas", "fan", "berisik",
    ],
    "layar": [
        "jernih", "tajam", "bening", "cerah", "bright", "gonjreng", "pucat",
        "warna", "akurat", "srgb", "ntsc", "ips", "oled", "amoled", "layar",
        "screen", "panel", "hz", "hertz", "refresh rate", "bezel", "tipis",
        "resolusi", "fhd", "4k", "retina", "pixel", "dead pixel", "shadow",
        "bocor", "backlight bleed", "silau", "matte", "glare",
    ],
    "baterai": [
        "awet", "tahan lama", "badak", "boros", "cepat habis", "drop",
        "cas", "charge", "charger", "charging", "watt", "adapter", "kabel",
        "type-c", "baterai", "battery", "mah", "tahan", "jam", "standby",
        "soak", "panas saat cas",
    ],
    "harga": [
        "murah", "mahal", "worth it", "value for money", "terjangkau",
        "ekonomis", "pricey", "kemahalan", "promo", "diskon", "flash sale",
        "bonus", "hadiah", "freebie", "ongkir", "budget", "pelajar",
        "kantong", "investasi", "padan", "sesuai harga",
    ],
}

# Sentiment classes (alphabetical order gives codes 0, 1, 2).
NEGATIVE, NEUTRAL, POSITIVE = "negatif", "netral", "positif"
SENTIMENTS = [NEGATIVE, NEUTRAL, POSITIVE]

# Verdict labels from best to worst, and the summary sentences.
VERDICT_LABELS = ("Sangat Direkomendasikan", "Layak Dipertimbangkan", "Kurang Disarankan")
SUMMARY_BEST = "Produk ini sangat unggul pada aspek {best}."
SUMMARY_WORST = " Namun, pengguna sering mengeluhkan {worst}."
SUMMARY_NONE = "Ulasan umum tidak spesifik membahas aspek teknis tertentu."

# Words that mark dates and interface text on review pages.
DATE_MARKERS = ["WIB", "lalu"]
DATE_WORDS = [
    "WIB", "lalu", "hari", "minggu", "bulan", "tahun", "Jan", "Feb", "Mar",
    "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des",
]
NOT_USERNAME = ["Beli", "WIB", "lalu", "Variasi", "bintang"]
NOT_REVIEW_TEXT = ["WIB", "lalu yang", "Variasi", "Beli di", "Terima kasih atas"]
RATING_WORD = "bintang"

# URL fragments that never belong to a product page.
URL_IGNORE = [
    "google", "facebook", "twitter",
    "/search?", "/discovery", "/hot",
    "/help", "/about", "/login", "/cart",
]
AD_HOST_PREFIX = "ta."
URL_COLUMN_NAMES = ["url", "urls", "link", "links"]

# Hyper-parameter grid (72 combinations).
GRID = {
    "learning_rate": [0.01, 0.1, 0.2],
    "max_depth": [3, 5, 7],
    "n_estimators": [100, 200],
    "subsample": [0.8, 1.0],
    "colsample_bytree": [0.8, 1.0],
}

# Common Indonesian function words, the default stop list.
STOPWORDS_ID = [
    "yang", "untuk", "pada", "ke", "para", "namun", "menurut", "antara", "dia",
    "dua", "ia", "seperti", "jika", "sehingga", "kembali", "dan", "tidak",
    "ini", "karena", "kepada", "oleh", "saat", "harus", "sementara", "setelah",
    "belum", "kami", "sekitar", "bagi", "serta", "di", "dari", "telah",
    "sebagai", "masih", "hal", "ketika", "adalah", "itu", "dalam", "bisa",
    "bahwa", "atau", "hanya", "kita", "dengan", "akan", "juga", "ada",
    "mereka", "sudah", "saya", "terhadap", "secara", "agar", "lain", "anda",
    "begitu", "mengapa", "kenapa", "yaitu", "yakni", "daripada", "itulah",
    "lagi", "maka", "tentang", "demi", "dimana", "kemana", "pula", "sambil",
    "sebelum", "sesudah", "supaya", "guna", "kah", "pun", "sampai",
    "sedangkan", "selagi", "tetapi", "apakah", "kecuali", "sebab", "selain",
    "seolah", "seraya", "seterusnya", "tanpa", "agak", "boleh", "dapat",
    "dsb", "dst", "dll", "dahulu", "dulunya", "anu", "demikian", "tapi",
    "ingin", "nggak", "mari", "nanti", "melainkan", "oh", "ok", "seharusnya",
    "sebetulnya", "setiap", "setidaknya", "sesuatu", "pasti", "saja", "toh",
    "ya", "walau", "tolong", "tentu", "amat", "apalagi", "bagaimanapun",
]
