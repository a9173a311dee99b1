"""Constants that define the semantics of the engine.

Everything between the FIXED VALUES markers must equal what the wearable
telemetry stack we mirror uses, or results (metric routing, alert text,
bands, categories) stop matching.  They are stated plainly, in natural order.
Names and defaults outside the markers are this library's own choices.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the mirrored system's)
# ---------------------------------------------------------------------------

# Reading type identifiers, in declaration order.
HK_HEART_RATE = "HKQuantityTypeIdentifierHeartRate"
HK_RESTING_HEART_RATE = "HKQuantityTypeIdentifierRestingHeartRate"
HK_HRV_SDNN = "HKQuantityTypeIdentifierHeartRateVariabilitySDNN"
HK_OXYGEN_SATURATION = "HKQuantityTypeIdentifierOxygenSaturation"
HK_BODY_TEMPERATURE = "HKQuantityTypeIdentifierBodyTemperature"
HK_STEP_COUNT = "HKQuantityTypeIdentifierStepCount"
HK_SLEEP_ANALYSIS = "HKCategoryTypeIdentifierSleepAnalysis"
HK_RESPIRATORY_RATE = "HKQuantityTypeIdentifierRespiratoryRate"

# Units.
UNIT_BPM = "count/min"
UNIT_MS = "ms"
UNIT_PERCENT = "%"
UNIT_CELSIUS = "degC"

# Type -> metric.  Anything else (including the two unmapped declared types
# and a missing type) is UNKNOWN_METRIC.
METRIC_BY_TYPE = {
    HK_HEART_RATE: "heart_rate",
    HK_HRV_SDNN: "hrv",
    HK_OXYGEN_SATURATION: "oxygen",
    HK_BODY_TEMPERATURE: "temperature",
    HK_STEP_COUNT: "movement",
    HK_RESPIRATORY_RATE: "respiration",
    HK_SLEEP_ANALYSIS: "sleep",
}
UNKNOWN_METRIC = "unknown"

# Broker topic naming: "<prefix>.<metric>" downstream of the bridge; the
# device side publishes on "<device prefix>/<metric>" with "/unknown" for
# unmapped types and subscribes with the one-level wildcard "<prefix>/+".
STREAM_TOPIC_PREFIX = "biometrics"
STREAM_TOPIC_PATTERN = r"biometrics\..*"
ALERTS_TOPIC = "alerts.detected"
BRIDGE_TAG = "mqtt-to-kafka"
ANONYMOUS_KEY = "anonymous"
DEFAULT_SOURCE = "simulator"

# Sleep stages: common prefix, then the six stage names.
STAGE_PREFIX = "HKCategoryValueSleepAnalysis"
STAGE_SPLIT_TOKEN = "Analysis"

# Rule thresholds.
HR_SLEEP_MAX = 90.0
HR_SLEEP_CRITICAL = 110.0
HR_TACHYCARDIA = 100.0
HR_TACHYCARDIA_MARGIN = 20.0
SPO2_LOW = 92.0
SPO2_HYPOXIA = 90.0
HRV_VERY_LOW = 20.0
TEMP_HIGH_FEVER = 38.0
TEMP_LOW_HYPOTHERMIA = 35.5

# Metric stats in the context snapshot cover these five metrics only.
CONTEXT_METRICS = ["heart_rate", "hrv", "oxygen", "temperature", "respiration"]

# Alert severities and rule categories.
SEVERITIES = ["critical", "warning", "info"]
CAT_CARDIO = "cardiovascular"
CAT_RESPIRATORY = "respiratory"
CAT_RECOVERY = "recovery"
CAT_GENERAL = "general"

# Alert titles and texts; {v} is the formatted value, {stage} the short stage.
TITLE_HR_ASLEEP = "Frecuencia cardíaca elevada durante el sueño"
TEXT_HR_ASLEEP = "HR={v} bpm en fase {stage}. Puede indicar pesadilla, fiebre o apnea del sueño."
TITLE_TACHY = "Frecuencia cardíaca elevada"
TEXT_TACHY = ("HR={v} bpm en reposo. Si no estás haciendo ejercicio, "
              "considera tomarte 5 min de respiración guiada.")
TITLE_SPO2_CRITICAL = "Saturación de oxígeno crítica"
TEXT_SPO2_CRITICAL = "SpO2={v}%. Por debajo del 90% es hipoxia. Consulta con un profesional si se repite."
TITLE_SPO2_LOW = "Saturación de oxígeno baja"
TEXT_SPO2_LOW = "SpO2={v}%. Lo normal es ≥95%. Si se repite, descarta apnea del sueño."
TITLE_HRV_LOW = "Variabilidad cardíaca muy baja"
TEXT_HRV_LOW = ("HRV={v} ms. Indica estrés acumulado o mala recuperación. "
                "Prueba meditación 10 min y evita cafeína mañana.")
TITLE_FEVER = "Temperatura corporal elevada (fiebre)"
TEXT_FEVER = "Temp={v} °C. Hidratación y reposo. Si persiste >24h, consulta médico."
TITLE_TEMP_LOW = "Temperatura corporal baja"
TEXT_TEMP_LOW = "Temp={v} °C. Puede ser un error de medición. Calienta la habitación si llevas frío."

# Notification text: icon per severity, default icon, labels.
SEVERITY_ICON = {"critical": "🚨", "warning": "⚠️", "info": "💡"}
DEFAULT_ICON = "📊"
DEFAULT_ALERT_TITLE = "Alerta"
LABEL_METRIC = "_Métrica:_"
LABEL_VALUE = "_Valor:_"

# Dashboard threshold bands: (lower bound inclusive, label), ascending.
BANDS = {
    "heart_rate": [(None, "green"), (80.0, "orange"), (100.0, "red")],
    "hrv": [(None, "red"), (30.0, "orange"), (50.0, "green")],
    "oxygen": [(None, "red"), (92.0, "orange"), (95.0, "green")],
    "temperature": [(None, "blue"), (36.1, "green"), (37.2, "orange"), (38.0, "red")],
    "alert_total": [(None, "green"), (5.0, "orange"), (10.0, "red")],
}

# Sleep-quality categories on the raw score, and the score clamp.
QUALITY_POOR_MAX = 6.0
QUALITY_GOOD_MAX = 8.0
QUALITY_POOR = "Insuficiente"
QUALITY_GOOD = "Buena"
QUALITY_EXCELLENT = "Excelente"
SCORE_MIN = 1.0
SCORE_MAX = 10.0

# Predict-request ranges (inclusive) and enums.
PREDICT_RANGES = {
    "age": (10, 100),
    "sleep_duration": (1, 14),
    "physical_activity": (0, 300),
    "stress_level": (1, 10),
    "heart_rate": (40, 200),
    "systolic": (80, 200),
}
PREDICT_ENUMS = {
    "gender": ["Male", "Female"],
    "bmi_category": ["Normal", "Overweight", "Obese"],
    "sleep_disorder": ["None", "Insomnia", "Sleep Apnea"],
}
DEFAULT_SLEEP_DISORDER = "None"

# Journal-entry ranges (inclusive) and defaults.
JOURNAL_MOOD = (1, 10)
JOURNAL_STRESS = (1, 10)
JOURNAL_SCREENS = (0, 600)

# Survey CSV header -> model column.
SURVEY_COLUMNS = {
    "Person ID": "person_id",
    "Gender": "gender",
    "Age": "age",
    "Occupation": "occupation",
    "Sleep Duration": "sleep_duration",
    "Quality of Sleep": "quality_of_sleep",
    "Physical Activity Level": "physical_activity",
    "Stress Level": "stress_level",
    "BMI Category": "bmi_category",
    "Blood Pressure": "blood_pressure",
    "Heart Rate": "heart_rate",
    "Daily Steps": "daily_steps",
    "Sleep Disorder": "sleep_disorder",
}
BMI_RENAME = {"Normal Weight": "Normal"}
NUMERIC_FEATURES = ["age", "sleep_duration", "physical_activity", "stress_level", "heart_rate", "systolic"]
CATEGORICAL_FEATURES = ["gender", "bmi_category", "sleep_disorder"]
TARGET = "quality_of_sleep"

# Model settings of the reference training run.
GBT_MAX_ITER = 200
GBT_MAX_DEPTH = 3
GBT_STEP = 0.1
SEED = 42
TRAIN_FRACTION = 0.8

# Stream cadence and windows.
RAW_TRIGGER = "2 seconds"
AGG_TRIGGER = "10 seconds"
AGG_WINDOW = "5 minutes"
AGG_SLIDE = "1 minute"
WATERMARK_DELAY = "1 minute"
HR_WATCH_WINDOW = "1 minute"

# ---------------------------------------------------------------------------
# END FIXED VALUES
# ---------------------------------------------------------------------------

# This library's own choices.
DEVICE_TOPIC_PREFIX = "wearable/devices"
NOTIFICATION_SIGNATURE = "pulsegrid"
HR_WATCH_LIMIT = 120.0

# ---------------------------------------------------------------------------
# FIXED VALUES: context Markdown labels (F2), in output order
# ---------------------------------------------------------------------------
MD_HEADER = "## Contexto biométrico del usuario (últimas {h} h)"
MD_NOW = "Timestamp actual (UTC): {now}"
MD_USER = "Usuario: {name} · cronotipo: {chronotype}"
MD_UNKNOWN_NAME = "desconocido"
MD_UNKNOWN_CHRONOTYPE = "n/a"
MD_STATS = "### Estadísticos por métrica"
MD_STAT_LINE = "- **{metric}**: n={n}, media={avg}, min={min}, max={max}"
MD_PHASES = "### Distribución de fases de sueño"
MD_PHASE_LINE = "- {stage}: {pct}% ({n} muestras)"
MD_ALERTS = "### Alertas detectadas (Spark Streaming)"
MD_ALERT_LINE = "- [{severity}] {title}: {text}"
MD_JOURNAL = "### Última entrada del diario"
MD_J_DATE = "- Fecha: {date}"
MD_J_MOOD = "- Mood: {mood}/10, estrés: {stress}/10"
MD_J_HABITS = "- Cafeína tarde: {caffeine}, alcohol: {alcohol}"
MD_J_SCREENS = "- Pantallas antes de dormir: {screens} min"
MD_J_NOTES = "- Notas: {notes}"
# END FIXED VALUES

# Own prompt presets (F3): short instructions of this library, not the mirrored text.
PROMPT_BASE = ("You are a sleep coach. Answer briefly, cite the user's numbers from the context "
               "when present, and end with one to three concrete suggestions. You are not a doctor.")
PROMPT_PRE_SLEEP = ("Evening check-in: ask about mood, stress, late caffeine, alcohol and exercise, "
                    "then suggest one thing for tonight.")
PROMPT_POST_SLEEP = ("Morning check-in: ask how the user feels, share two or three sleep figures from "
                     "the context and suggest one adjustment for today.")
