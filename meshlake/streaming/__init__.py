"""Extension: operators over unbounded inputs."""
