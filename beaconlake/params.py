"""Parameters and fixed dimensions shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

SEQ_MOD = 1 << 16
COUNTER_MOD = 1 << 32
KEYFRAME_EVERY = 50
MAX_TASKS = 16
SYSTEM_TAG = 15
OFFLINE_SECONDS = 30
SCRAPE_SECONDS, PUSH_SECONDS, PROGRESS_SECONDS = 5, 30, 10
PROFILE_BLOCK = 100

#: Labels of task states 0 to 4.
TASK_STATES = ["running", "ready", "blocked", "suspended", "deleted"]

#: Metric, name and unit in the semantic convention. Own: scope and help text.
METRICS = [
    ("rtos_heap_free_bytes", "rtos.heap.free_bytes", "By", "device", "Bytes of heap that are free now"),
    ("rtos_heap_min_ever_bytes", "rtos.heap.min_ever_bytes", "By", "device", "Fewest free heap bytes since the start"),
    ("rtos_heap_oom_projection_seconds", "rtos.heap.oom_projection_seconds", "s", "device", "Seconds until no heap is left at the present trend; -1 without a leak, -2 with a falling minimum"),
    ("rtos_cpu_utilization_ratio", "rtos.cpu.utilization_ratio", "1", "device", "Busy part of the processor, from 0 to 1"),
    ("rtos_telemetry_packet_loss_ratio", "rtos.telemetry.packet_loss_ratio", "1", "device", "Part of the packets that did not arrive, from 0 to 1"),
    ("rtos_task_state", "rtos.task.state", "1", "task", "1 for the state that the task is in, 0 for the others"),
    ("rtos_task_stack_watermark_bytes", "rtos.task.stack_watermark", "By", "task", "Fewest free stack bytes since the start"),
    ("rtos_task_cpu_ratio", "rtos.task.cpu_ratio", "1", "task", "Part of the run time that the task took, from 0 to 1"),
]

#: Panel thresholds as (metric, lower bound inclusive, class); the class of the highest bound that is reached holds.
THRESHOLDS = [
    ("rtos_cpu_utilization_ratio", float("-inf"), "green"),
    ("rtos_cpu_utilization_ratio", 0.7, "orange"),
    ("rtos_cpu_utilization_ratio", 0.9, "red"),
    ("rtos_heap_oom_projection_seconds", float("-inf"), "red"),
    ("rtos_heap_oom_projection_seconds", 60.0, "orange"),
    ("rtos_heap_oom_projection_seconds", 300.0, "green"),
    ("rtos_task_stack_watermark_bytes", float("-inf"), "red"),
    ("rtos_task_stack_watermark_bytes", 128.0, "orange"),
    ("rtos_task_stack_watermark_bytes", 256.0, "green"),
    ("rtos_telemetry_packet_loss_ratio", float("-inf"), "green"),
    ("rtos_telemetry_packet_loss_ratio", 0.05, "orange"),
    ("rtos_telemetry_packet_loss_ratio", 0.1, "red"),
]


@dataclass(frozen=True)
class OomParams:
    """Leak analytics. ``total_heap_bytes`` is the default where no device dimension gives another."""

    window_size: int = 600
    min_samples: int = 30
    r_squared_threshold: float = 0.7
    rolling_min_threshold: float = 0.10
    total_heap_bytes: int = 131072
