"""Defaults of the monitoring operators. Every operator takes its columns and limits as arguments; these are their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    label: str = "fault"
    time: str = "created_at"
    tie: str = "id"
    breaks: tuple[str, ...] = ("fault", "rpm")
    session_gap_s: float = 60.0
    event_gap_s: float = 10.0
    cadence_s: float = 2.0
    cadence_slack_s: float = 0.25
    unit_tolerance: float = 0.02
    tukey: float = 1.5
    tukey_extreme: float = 3.0
    window: int = 50
    folds: int = 5
    trees: int = 400
    seed: int = 0
    least_score: float = 0.15
    least_confidence: float = 0.30
    least_readings: int = 10
    scope_score: float = 0.17
    margin: float = 0.25
    share: float = 0.45
    history: int = 4
    dims: int = 256


DEFAULTS = Config()

# Columns that are one measure in two units, as (column to drop, column kept, factor, offset), kept = dropped * factor + offset.
UNIT_PAIRS = (
    ("z_rms_velocity_in_s", "z_rms_velocity_mm_s", 25.4, 0.0),
    ("x_rms_velocity_in_s", "x_rms_velocity_mm_s", 25.4, 0.0),
    ("z_peak_velocity_in_s", "z_peak_velocity_mm_s", 25.4, 0.0),
    ("x_peak_velocity_in_s", "x_peak_velocity_mm_s", 25.4, 0.0),
    ("temperature_f", "temperature_c", 5 / 9, -160 / 9),
)
# Columns that tell the order of collection; stems of labels that are states; marks of a repeated session.
LEAKS = ("id", "created_at")
STATE_STEMS = ("normal", "baseline", "teste", "acelerando", "motor_desligado", "mortor_desligado", "normla")
SESSION_SUFFIXES = ("_pos_2", "_carga", "_novo", "_adxl", "_antigo", "_teste")
SESSION_PREFIXES = ("new_",)
# Fields of a procedure and the patterns of their sections' titles, without accents and in lower case.
FIELD_PATTERNS = (
    ("objetivo", r"objetivo"),
    ("introducao", r"introducao|conceitos fundamentais"),
    ("descricao_problema", r"descricao do problema|caracterizacao da falha|componentes d"),
    ("causas", r"causas|modos de falha|tipos de falha|tipos de desalinhamento|principais tipos"),
    ("sintomas", r"sintomas"),
    ("ferramentas", r"ferramentas|instrumentos"),
    ("seguranca", r"seguranca"),
    ("inspecao_visual", r"inspecao visual"),
    ("diagnostico_vibracao", r"diagnostico por vibracao|diagnostico inicial|analise espectral|medicao de vibracao|caracteristicas vibracionais|frequencias caracteristicas|diagnostico por envelope|diagnostico de defeito"),
    ("correcao", r"correcao|balanceamento|substituicao|instalacao do novo|preparacao para"),
    ("validacao", r"validacao|verificacao final|verificacao dinamica|monitoramento pos"),
    ("criterios_aceitacao", r"criterios de aceitacao"),
    ("registro", r"registro d"),
    ("preventivas", r"preventiv|boas praticas|cuidados durante"),
    ("indicadores", r"indicadores"),
)
# What an input record must have, and the bounds of its numbers.
REQUIRED_FIELDS = ("z_rms_velocity_mm_s", "x_rms_velocity_mm_s", "rpm")
FIELD_RANGES = {
    "rpm": (0.0, 10_000.0),
    "temperature_c": (-40.0, 200.0),
    "z_rms_velocity_mm_s": (0.0, 1_000.0),
    "x_rms_velocity_mm_s": (0.0, 1_000.0),
    "z_peak_velocity_mm_s": (0.0, 1_000.0),
    "x_peak_velocity_mm_s": (0.0, 1_000.0),
    "z_rms_acceleration_g": (0.0, 100.0),
    "x_rms_acceleration_g": (0.0, 100.0),
    "z_peak_acceleration_g": (0.0, 500.0),
    "x_peak_acceleration_g": (0.0, 500.0),
    "z_high_freq_rms_accel_g": (0.0, 100.0),
    "x_high_freq_rms_accel_g": (0.0, 100.0),
    "z_kurtosis": (0.0, 500.0),
    "x_kurtosis": (0.0, 500.0),
    "z_crest_factor": (0.0, 100.0),
    "x_crest_factor": (0.0, 100.0),
    "z_peak_vel_comp_freq_hz": (0.0, 10_000.0),
    "x_peak_vel_comp_freq_hz": (0.0, 10_000.0),
}
