"""Fixed values of the kitchen domain: what names, units and wordings mean. Callers may pass tables of their own."""

from __future__ import annotations

#: Ounces in a cup of a good.
OUNCES_PER_CUP = {
    "flour": 4.25, "ap_flour": 4.25, "all_purpose_flour": 4.25, "bread_flour": 4.5, "cake_flour": 3.75, "whole_wheat_flour": 4.5,
    "sugar": 7, "white_sugar": 7, "brown_sugar": 7.5, "powdered_sugar": 4.5, "butter": 8, "softened_butter": 8, "oil": 7.5, "olive_oil": 7.5,
    "honey": 12, "milk": 8.5, "heavy_cream": 8.5, "buttermilk": 8.5, "water": 8.35, "cocoa": 3, "cornstarch": 4.5, "oats": 3, "rolled_oats": 3,
    "rice": 6.5, "raisins": 5.5, "chocolate_chips": 6, "salt": 10, "kosher_salt": 5, "salt_kosher": 5, "baking_powder": 8, "baking_soda": 8,
    "paprika": 3.9, "cinnamon": 4, "cinnamon_ground": 4, "ground_cinnamon": 4, "nutmeg": 3.8, "ground_nutmeg": 3.8, "black_pepper": 3.8,
    "pepper": 3.8, "white_pepper": 4.5, "cumin": 3.3, "ground_cumin": 3.3, "chili_powder": 3.8, "curry_powder": 3.6, "garlic_powder": 3.7,
    "onion_powder": 3.7, "allspice": 3.7, "ground_allspice": 3.7, "cloves": 3.7, "ginger": 4, "ground_ginger": 3.8, "turmeric": 4.3,
    "mustard_powder": 3.1, "cayenne": 3.8, "whole_black_pepper": 4, "black_pepper_whole": 4, "whole_cumin": 3.4, "whole_cloves": 3,
    "oregano": 1.5, "basil": 1.5, "thyme": 1.5, "rosemary": 1.5, "parsley": 1.4, "dill": 1.5, "sage": 1.5, "bay_leaves": 0.5, "whole_bay_leaves": 0.5,
    "vanilla": 8.5, "vanilla_extract": 8.5, "soy_sauce": 9, "fish_sauce": 9, "vinegar": 8, "maple_syrup": 11, "molasses": 11, "corn_syrup": 11.5,
    "mayonnaise": 7.7, "mayo": 7.7, "mustard": 8.5, "ketchup": 8.5, "tahini": 9.5, "peanut_butter": 9, "yeast": 5, "active_dry_yeast": 5,
    "dry_active_yeast": 5, "yeast_dry_active": 5, "sour_cream": 8.5, "yogurt": 8.5, "ricotta": 8.7, "cream_cheese": 8, "cornmeal": 5, "corn_meal": 5,
    "grits": 5.6, "bread_crumbs": 4, "breadcrumbs": 4, "panko": 1.75, "onion": 5.6, "red_onion": 5.6, "yellow_onion": 5.6, "onion_yellow": 5.6,
    "onion_red": 5.6, "white_onion": 5.6, "shallot": 5.3, "carrot": 4.4, "celery": 4.2, "potato": 5.3, "idaho_potato": 5.3, "potato_idaho": 5.3,
    "russet_potato": 5.3, "sweet_potato": 4.6, "tomato": 6.3, "plum_tomato": 6.3, "plum_tomatoes": 6.3, "cherry_tomato": 6, "bell_pepper": 5.3,
    "jalapeno": 3.5, "cucumber": 4.7, "mushroom": 2.5, "mushrooms": 2.5, "cabbage": 2.5, "broccoli": 3.1, "cauliflower": 3.5, "corn": 5.8,
    "green_beans": 3.9, "spinach": 1, "lettuce": 2, "cilantro": 1.3, "garlic": 4.8,
}

#: Ounces of a piece of a good, by name and unit.
PIECE_OUNCES = {
    ("garlic", "clove"): 0.18, ("garlic", "cloves"): 0.18, ("garlic", "ea_cloves"): 0.18, ("garlic", "-10_ea"): 0.18, ("garlic", "–10_ea"): 0.18,
    ("celery", "rib"): 1.4, ("celery", "ribs"): 1.4, ("celery", "stalk"): 1.4, ("celery", "stalks"): 1.4,
    ("basil", "sprig"): 0.2, ("basil", "sprigs"): 0.2, ("basil", "large_sprig"): 0.3, ("basil", "large_sprigs"): 0.3,
    ("basil", "-4_large_sprigs"): 0.3, ("basil", "–4_large_sprigs"): 0.3, ("basil", "-10_ea"): 0.3, ("basil", "–10_ea"): 0.3,
    ("rosemary", "sprig"): 0.15, ("rosemary", "stick"): 0.15, ("rosemary", "sticks"): 0.15, ("thyme", "sprig"): 0.05, ("thyme", "sprigs"): 0.05,
    ("whole_bay_leaves", "–10_ea"): 0.02, ("whole_bay_leaves", "-10_ea"): 0.02, ("whole_bay_leaves", "ea"): 0.02, ("whole_bay_leaves", "each"): 0.02,
    ("bay_leaves", "each"): 0.02, ("bay_leaves", "ea"): 0.02, ("lemon_grass", "stick"): 2.0, ("lemon_grass", "sticks"): 2.0,
}

#: What abbreviations in descriptions stand for.
ABBREVIATIONS = {
    "BRST": "Breast", "BNLS": "Boneless", "B/L": "Boneless", "SKLS": "Skinless", "BNINSKON": "Bone-In Skin-On", "BLSL": "Boneless Skinless",
    "THGH": "Thigh", "WNG": "Wing", "DRMS": "Drumsticks", "TNDR": "Tender", "TNDRLN": "Tenderloin", "STRP": "Strip", "LOIN": "Loin", "SHK": "Shank",
    "SHLDR": "Shoulder", "BRSKT": "Brisket", "BUTT": "Butt", "HAL": "Halves", "HLF": "Half", "QTR": "Quarter", "WHL": "Whole", "CHKN": "Chicken",
    "CHIK": "Chicken", "TRKY": "Turkey", "BF": "Beef", "PRK": "Pork", "BCN": "Bacon", "CKD": "Cooked", "RAW": "Raw", "FZN": "Frozen", "FRS": "Fresh",
    "IQF": "Frozen", "GRD": "Ground", "GRND": "Ground", "BRD": "Breaded", "BRDED": "Breaded", "GRL": "Grilled", "GRLD": "Grilled",
    "GRL MRK": "Grill Marked", "SMK": "Smoked", "SMKD": "Smoked", "CURED": "Cured", "STMD": "Steamed", "CVP": "Cryovac Packed",
    "NAE": "No Antibiotics", "SLI": "Sliced", "SLCD": "Sliced", "SHRD": "Shredded", "SHRDD": "Shredded", "CHOPPED": "Chopped", "DICED": "Diced",
    "CUBED": "Cubed", "PULLED": "Pulled", "CHOPPD": "Chopped", "CRMBL": "Crumbled", "CRMBLS": "Crumbles", "GRTD": "Grated", "PLAS": "Plastic",
    "PLA": "Plastic", "PPR": "Paper", "POUC": "Pouch", "SM": "Small", "MED": "Medium", "LRG": "Large", "JBO": "Jumbo", "JMBO": "Jumbo",
    "XL": "Extra Large", "XXL": "Extra Extra Large", "AVG": "Average", "PRM": "Premium", "PRT": "Portion", "WGT": "Weight", "VEG": "Vegetable",
    "VEGGIE": "Vegetable", "CHOC": "Chocolate", "VAN": "Vanilla", "STRAW": "Strawberry", "BLU": "Blueberry", "TOM": "Tomato", "SPIC": "Spicy",
    "TRT": "Tart", "SWT": "Sweet", "MILK": "Milk", "MK": "Milk", "WHL M": "Whole Milk", "CRM": "Cream", "BTR": "Butter", "YGRT": "Yogurt",
    "CHS": "Cheese", "EGG": "Egg", "ESL": "Extended Shelf Life", "ORIG": "Original", "ASST": "Assorted", "REG": "Regular", "FRTR": "Fritter",
    "EGGRL": "Egg Roll", "EGGROLL": "Egg Roll", "NTRL": "Natural", "PKD": "Packed", "TILAPIA": "Tilapia", "SALMON": "Salmon", "FILET": "Filet",
    "FIL": "Filet",
}

#: Words that make a name more specific, so a text without them means something else.
QUALIFIERS = (
    "dried frozen canned cooked raw powdered powder smoked pickled jarred bottled concentrated condensed decaf instant whole ground minced "
    "shredded grated sliced diced chopped crushed pureed roasted toasted baked fried steamed fresh"
).split()
#: Packaging words that name no good, and nouns of dishes that a name must share with a text.
PACKAGING = "bag box case carton pack container pouch jar bottle can piece each unit crate tray lid cup".split()
DISHES = (
    "muffin scone biscuit cookie brownie blondie cake cupcake cheesecake pie cobbler tart turnover donut doughnut croissant danish eclair strudel "
    "bread loaf baguette roll bun bagel tortilla wrap pita naan focaccia ciabatta soup salad sandwich patty burger eggroll pizza calzone stromboli"
).split()
#: Categories that a section of an invoice may hold.
SECTION_CATEGORIES = {
    "DAIRY": ["Dairy"], "PRODUCE": ["Produce"], "MEATS": ["Proteins"], "MEAT": ["Proteins"], "POULTRY": ["Proteins"], "SEAFOOD": ["Proteins"],
    "CANNED": ["Drystock"], "DRY": ["Drystock", "Spices"], "PAPER": ["Smallwares"], "DISPOSABLE": ["Smallwares"], "JANITORIAL": ["Chemicals"],
    "CHEMICAL": ["Chemicals"], "BEVERAGE": ["Coffee/Concessions"], "BAKERY": ["Bakery"], "DELI": ["Proteins", "Dairy"], "SPICES": ["Spices"],
    "GROCERY": ["Drystock"],
}
#: Phrases of charges and credits, which are no goods.
CHARGES = [
    "CHGS FOR FUEL", "FUEL SURCHARGE", "DELIVERY FEE", "DELIVERY CHG", "DELIVERY CHARGE", "CREDIT MEMO", "ORDER SUMMARY", "MISC CHARGES",
    "MISC CHARGE", "ADMIN FEE", "SERVICE CHARGE", "ENV CHARGE", "ENVIRONMENTAL FEE", "SURCHARGE", "FREIGHT", "SALES TAX", "CC PROCESSING FEE",
    "PROCESSING FEE", "CREDIT CARD",
]
#: Wordings of lines that are no items, whole lines and phrases anywhere.
JUNK_LINES = ["COM", "PRICE", "TOTAL", "AMOUNT", "CLOSE:", "OPEN:", "IMP", "INVOICE NUMBER", "ITEM DESCRIPTION", "PURCHASE ORDER", "1.00 HALF", "6#10"]
JUNK_PHRASES = [
    "GROUP TOTAL", "ORDER SUMMARY", "MISC CHARGE", "CHARGE FOR", "SALES TAX", "DELIVERY FEE", "FUEL SURCHARGE", "CREDIT CARD CHARGE", "REMOTE STOCK",
    "OUT/STOCK", "PART/ORD", "T/WT=", "NOT AVAILABLE", "NO LONGER AVAILABLE", "OUR ORDER NUMBER", "DAY NOTICE",
]
#: Names of an invoice's sections, as they may run into a description.
SECTIONS = "DAIRY MEATS POULTRY SEAFOOD FROZEN PRODUCE BAKERY BEVERAGE CANNED DRY CHEMICAL JANITORIAL PAPER DISP SUPPLY DISPENSER MISC".split()
#: Words that a proposed name leaves out.
NAME_NOISE = (
    "oz lb gal qt pt ml kg gram grams ct cs ea dz pk pkg bx bg cn qty each count case pack box bag can cont iqf cvp fz frz fzn wht whl aa usda gr "
    "med lrg sm jbo rtb rts rtu esl avg choice fancy select prime"
).split()

#: Postal codes of states, districts, territories and military posts.
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA "
    "WV WI WY DC PR VI GU AS MP FM MH PW AA AE AP"
).split()
