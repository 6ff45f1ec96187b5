"""pulsegrid: Spark-native operators for waveform-lidar analytics."""
