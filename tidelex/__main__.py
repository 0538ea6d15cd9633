from tidelex.plans.cli import main

main()
