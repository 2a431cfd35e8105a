"""What runs on the driver: settings, job records, archives, commands."""
