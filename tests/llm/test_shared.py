"""What the driver gives back between steps."""

import time

from stratum.llm.shared import _diagnose, tidy

RATIOS = ("MinHeapFreeRatio", "MaxHeapFreeRatio")


def test_tidy_gives_the_heap_back(spark):
    jvm = spark.sparkContext._jvm
    runtime = jvm.Runtime.getRuntime()
    bean = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
    ratios = [bean.getVMOption(k).getValue() for k in RATIOS]
    alive = jvm.java.nio.ByteBuffer.allocate(100 << 20)
    garbage = [jvm.java.nio.ByteBuffer.allocate(16 << 20) for _ in range(40)]
    assert runtime.totalMemory() > 700 << 20
    del garbage
    for _ in range(10):  # py4j lets go of what Python has dropped a little later
        tidy(spark)
        used = runtime.totalMemory() - runtime.freeMemory()
        if used < 500 << 20:
            break
        time.sleep(0.2)
    assert alive.capacity() == 100 << 20 and 100 << 20 <= used < 500 << 20
    assert runtime.totalMemory() < 1.7 * used
    assert [bean.getVMOption(k).getValue() for k in RATIOS] == ratios


def test_tidy_trims_what_the_jvm_has_freed(spark):
    assert "Trim native heap" in _diagnose(spark, "systemTrimNativeHeap")
