"""The same readings over streams."""
