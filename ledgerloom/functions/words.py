"""Word lists and tables that results depend on."""

DAYS = ["senin", "selasa", "rabu", "kamis", "jumat", "sabtu", "minggu"]
# Months as the page interpreter knows them (no "dec", "ags" or "oct").
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "nov": 11, "des": 12,
    "januari": 1, "februari": 2, "maret": 3, "april": 4, "mei": 5, "juni": 6, "juli": 7, "agustus": 8, "september": 9, "oktober": 10,
    "november": 11, "desember": 12,
}
# Months as the corrector knows them.
CORRECTOR_MONTHS = {
    "jan": 1, "januari": 1, "feb": 2, "februari": 2, "mar": 3, "maret": 3, "apr": 4, "april": 4, "mei": 5, "jun": 6, "jul": 7, "ags": 8,
    "agustus": 8, "sep": 9, "september": 9, "okt": 10, "oktober": 10, "nov": 11, "november": 11, "des": 12, "desember": 12,
}
# Months as the exporter knows them, by their first three letters ("agu" is unknown).
EXPORT_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "mei": 5, "may": 5, "jun": 6, "jul": 7, "ags": 8, "aug": 8, "sep": 9, "okt": 10, "nov": 11, "des": 12}
SYMBOLS = ["@", "x", "X", "+", "=", "→", "★", "×", "Rp"]
PRODUCT_WORDS = (
    "kopi teh susu jeruk es air aqua galon makan nasi telur mie goreng donat ketan nagasari gorengan sosis roti rokok cigarette madu karamel kecap "
    "saus garam gula minyak terigu beras kentang wortel kangkung bayam kacang tempe tahu ayam ikan sapi cemilan snack permen mint klem bungkus batang "
    "pcs kaleng botol porsi gelas liter kg"
).split()
# Spellings with another canonical form, the longest first.
ALIASES = [("mie instan", "indomie"), ("kopi hitam", "kopi"), ("aqua glas", "aqua gelas"), ("indomi", "indomie"), ("t jus", "teh jus"), ("es t", "es teh"), ("mie", "indomie"), ("gls", "aqua gelas")]
# Letter pairs and what they sound like, in order.
SOUNDS = [("kh", "k"), ("sy", "s"), ("ch", "c"), ("ng", "n"), ("ny", "n"), ("gh", "g"), ("ts", "c"), ("dj", "j")]
# Characters that scans mix up: (from, to) for each context.
CONFUSED = {
    "product": ("0O1l/23456789gU", "DDIIIZEASGTBqqV"),
    "price": ("ODlI/ZEASGbgTBq", "001112345666789"),
    "mixed": ("0O1l/23456bg789U", "DDIIIZEASGGGTBqV"),
}
# Prices of what has none: the first word that the name holds counts.
FALLBACK_PRICES = [
    ("kopi", 5000), ("es kopi", 7000), ("teh", 4000), ("es teh", 5000), ("aqua k", 3000), ("aqua", 3000), ("aqua galon", 6000), ("galon", 6000), ("susu", 5000),
    ("gorengan", 2500), ("donat", 2000), ("mie", 8000), ("pop mie", 6000), ("rokok", 25000), ("es batu", 1000), ("cimory", 9000), ("roti", 3000),
]
OTHER_PRICE, OTHER_ITEM, OTHER_CUSTOMER = 5000, "Item Lainnya", "Umum"
