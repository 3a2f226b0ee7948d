"""Flag numbers and comment codes of the monitoring programs.

Fixed values: the data dictionary's lists, in its order.
"""

FLAG_LABELS = {
    -5: "Outside high sensor range",
    -4: "Outside low sensor range",
    -3: "Data rejected due to QA/QC",
    -2: "Missing data",
    -1: "Optional parameter not collected",
    0: "Passed initial QAQC checks",
    1: "Suspect data",
    2: "Reserved for future use",
    3: "Calculated data: non-vented depth/level sensor correction for changes in barometric pressure",
    4: "Historical: Pre-auto QA/QC",
    5: "Corrected data",
}

WATER = {
    "GIC": "no instrument deployed due to ice",
    "GIM": "instrument malfunction",
    "GIT": "instrument recording error; recovered telemetry data",
    "GMC": "no instrument deployed due to maintenance/calibration",
    "GNF": "deployment tube clogged / no flow",
    "GOW": "out of water event",
    "GPF": "power failure / low battery",
    "GQR": "data rejected due to QA/QC checks",
    "GSM": "see metadata",
    "SBO": "blocked optic",
    "SCF": "conductivity sensor failure",
    "SDF": "depth port frozen",
    "SDG": "suspect due to sensor diagnostics",
    "SDO": "DO suspect",
    "SDP": "DO membrane puncture",
    "SIC": "incorrect calibration / contaminated standard",
    "SNV": "negative value",
    "SOW": "sensor out of water",
    "SPC": "post calibration out of range",
    "SSD": "sensor drift",
    "SSM": "sensor malfunction",
    "SSR": "sensor removed / not deployed",
    "STF": "catastrophic temperature sensor failure",
    "STS": "turbidity spike",
    "SWM": "wiper malfunction / loss",
    "CAB": "algal bloom",
    "CAF": "acceptable calibration / accuracy error of sensor",
    "CAP": "depth sensor in water; affected by atmospheric pressure",
    "CBF": "biofouling",
    "CCU": "cause unknown",
    "CDA": "DO hypoxia (<3 mg/L)",
    "CDB": "disturbed bottom",
    "CDF": "data appear to fit conditions",
    "CFK": "fish kill",
    "CIP": "surface ice present at sample station",
    "CLT": "low tide",
    "CMC": "in field maintenance / cleaning",
    "CMD": "mud in probe guard",
    "CND": "new deployment begins",
    "CRE": "significant rain event",
    "CSM": "see metadata",
    "CTS": "turbidity spike",
    "CVT": "possible vandalism/tampering",
    "CWD": "data collected at wrong depth",
    "CWE": "significant weather event",
}

WEATHER = {
    "GIM": "instrument malfunction",
    "GIT": "instrument recording error, recovered telemetry data",
    "GMC": "no instrument deployed due to maintenance/calibration",
    "GMT": "instrument maintenance",
    "GPD": "powered down",
    "GPF": "power failure/low battery",
    "GPR": "program reload",
    "GQR": "data rejected due to QAQC",
    "GSM": "see metadata",
    "SDG": "suspect due to sensor diagnostics",
    "SIC": "incorrect calibration constant, multiplier or offset",
    "SIW": "incorrect wiring",
    "SMT": "sensor maintenance",
    "SNV": "negative value",
    "SOC": "out of calibration",
    "SSN": "not a number/unknown value",
    "SSM": "sensor malfunction",
    "SSR": "sensor removed",
    "CAF": "acceptable calibration/accuracy error of sensor",
    "CDF": "data appear to fit conditions",
    "CML": "snow melt from previous snowfall event",
    "CRE": "significant rain event",
    "CSM": "see metadata",
    "CCU": "cause unknown",
    "CVT": "possible vandalism/tampering",
    "CWE": "significant weather event",
}

NUTRIENT = {
    "GCM": "calculated value could not be determined due to missing data",
    "GCR": "calculated value could not be determined due to rejected data",
    "GDM": "data missing or sample never collected",
    "GQD": "data rejected due to QA/QC checks",
    "GQS": "data suspect due to QA/QC checks",
    "SBL": "value below minimum limit of method detection",
    "SCB": "value calculated with a value that is below the MDL",
    "SCC": "calculation with this component resulted in a negative value",
    "SNV": "calculated value is negative",
    "SRD": "replicate values differ substantially",
    "SUL": "value above upper limit of method detection",
    "CAB": "algal bloom",
    "CDR": "sample diluted and rerun",
    "CHB": "sample held beyond specified holding time",
    "CIF": "flotsam present in sample vicinity",
    "CIP": "ice present in sample vicinity",
    "CLE": "sample collected earlier / later than scheduled",
    "CRE": "significant rain event",
    "CSM": "see metadata",
    "CUS": "lab analysis from unpreserved sample",
}

RECORD = {
    "CAB": "algal bloom",
    "CHB": "sample held beyond specified holding time",
    "CIF": "flotsam present in sample vicinity",
    "CIP": "ice present in sample vicinity",
    "CLE": "sample collected earlier/later than scheduled",
    "CRE": "significant rain event",
    "CUS": "lab analysis from unpreserved sample",
    "CSM": "see metadata",
    "CCL": "clear (0-10%)",
    "CSP": "scattered to partly cloudy (10-50%)",
    "CPB": "partly to broken (50-90%)",
    "COC": "overcast (>90%)",
    "CFY": "foggy",
    "CHY": "hazy",
    "CCC": "cloud (no percentage)",
    "PNP": "none",
    "PDR": "drizzle",
    "PLR": "light rain",
    "PHR": "heavy rain",
    "PSQ": "squally",
    "PFQ": "frozen precipitation (sleet/snow/freezing rain)",
    "PSR": "mixed rain and snow",
    "TSE": "ebb tide",
    "TSF": "flood tide",
    "TSH": "high tide",
    "TSL": "low tide",
    "WH0": "0 to <0.1 meters",
    "WH1": "0.1 to 0.3 meters",
    "WH2": "0.3 to 0.6 meters",
    "WH3": "0.6 to > 1.0 meters",
    "WH4": "1.0 to 1.3 meters",
    "WH5": "1.3 or greater meters",
    "N": "from the north",
    "NNE": "from the north northeast",
    "NE": "from the northeast",
    "ENE": "from the east northeast",
    "E": "from the east",
    "ESE": "from the east southeast",
    "SE": "from the southeast",
    "SSE": "from the south southeast",
    "S": "from the south",
    "SSW": "from the south southwest",
    "SW": "from the southwest",
    "WSW": "from the west southwest",
    "W": "from the west",
    "WNW": "from the west northwest",
    "NW": "from the northwest",
    "NNW": "from the north northwest",
    "WS0": "0 to 1 knot",
    "WS1": "> 1 to 10 knots",
    "WS2": "> 10 to 20 knots",
    "WS3": "> 20 to 30 knots",
    "WS4": "> 30 to 40 knots",
    "WS5": "> 40 knots",
}

LEGACY_NUTRIENT = {
    "A": "Value above upper limit of method detection",
    "B": "Value below method detection limit",
    "C": "Calculated value",
    "D": "Data deleted or calculated value could not be determined due to deleted data, see metadata for details",
    "H": "Sample held beyond specified holding time",
    "K": "Check metadata for further details",
    "M": "Data missing, sample never collected or calculated value could not be determined due to missing data",
    "P": "Significant precipitation (reserve defined, see metadata for further details)",
    "N": "Calculated value is negative",
    "U": "Lab analysis from unpreserved sample",
    "S": "Data suspect, see metadata for further details",
}

CODES = {
    "water": WATER,
    "weather": WEATHER,
    "nutrient": NUTRIENT,
    "record": RECORD,
    "legacy nutrient": LEGACY_NUTRIENT,
}
